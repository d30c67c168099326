"""SimHash and substring dedup against brute force."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from hushframe.llm import blocks, simhash, substring
from hushframe.llm.blocks import forest, linked
from hushframe.llm.components import components
from tests_near import least, paragraph_losers, plain_fingerprint


def test_fingerprints_and_components(docs):
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    rows = docs.select("doc_id", "text").collect()
    fp = [plain_fingerprint(r["text"]) for r in rows]
    assert all(got[r["doc_id"]]["fp"] % (1 << 64) == f for r, f in zip(rows, fp, strict=True))
    links = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if (fp[i] ^ fp[j]).bit_count() <= 4]
    assert [got[r["doc_id"]]["component_id"] for r in rows] == least([r["doc_id"] for r in rows], links)


def test_dense_and_hot_groups_lose_no_link(spark):
    rng = np.random.default_rng(3)
    centre = int(rng.integers(1 << 62))
    fps = {centre}
    for _ in range(700):
        x = centre
        for b in rng.integers(0, 64, rng.integers(1, 6)):
            x ^= 1 << int(b)
        fps.add(x)
    fps = sorted(fps | {int(x) for x in rng.integers(0, 1 << 62, 300)})
    ids = list(range(len(fps)))
    points = spark.createDataFrame([(i, int(np.uint64(f).astype(np.int64))) for i, f in zip(ids, fps, strict=True)], "node long, fp long")
    links = [(i, j) for i, j in itertools.combinations(ids, 2) if (fps[i] ^ fps[j]).bit_count() <= 4]
    want = least(ids, links)
    found = {r["node"]: r["root"] for r in components(simhash.near_links(points)).collect()}
    assert [found.get(i, i) for i in ids] == want


def test_groups_beyond_the_limit_are_cut_into_blocks(spark):
    rows = spark.createDataFrame([(1, i, i) for i in range(500)] + [(2, i, i) for i in range(600, 610)], "key long, node long, v long")

    def link(data):
        v = data.to_numpy()
        return forest(len(v), lambda i, rest: np.abs(v[rest] - v[i]) <= 1)

    found = {r["node"]: r["root"] for r in components(linked(rows, "v", link, group=64)).collect()}
    assert [found.get(i, i) for i in range(500)] == [0] * 500 and all(found.get(i, i) == 600 for i in range(600, 610))


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 5), (9, 8), (8, 8), (None, 1), (4, 5)] + [(i, i + 1) for i in range(100, 130)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert got == {5: 3, 4: 3, 9: 8} | {i: 100 for i in range(101, 131)}
    assert components(edges.limit(0)).count() == 0


def test_simhash_edge_cases(odd, none):
    got = [(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(odd).collect()]
    assert sorted(x for x in got if x[0] in (1, 2)) == [(1, 1), (1, 1), (2, 1)]
    assert {c for d, c in got if d in (3, 4, 5)} == {3} and len(got) == odd.count()
    assert simhash.near_duplicates(none).count() == 0
    kept = [r["doc_id"] for r in simhash.keep_first(odd).collect()]
    assert sorted(x for x in kept if x is not None) == [1, 3, 6, 7, 8] and kept.count(None) == 2
    assert simhash.keep_first(odd).columns == odd.columns and simhash.keep_first(none).count() == 0


def words(rng, n):
    return [f"w{rng.integers(1_000_000)}" for _ in range(n)]


def test_passages_are_cut_from_all_but_the_first(spark):
    rng = np.random.default_rng(1)
    shared, line = words(rng, 60), words(rng, 40)
    near = [*line[:-1], "changed"]
    rows = []
    for i in range(12):
        own = words(rng, 80)
        body = {0: " ".join(own[:30] + shared + own[30:]), 1: " ".join(own) + "\n" + " ".join(line if i % 2 else near) + "\nshort line", 2: " ".join(own)}[i % 3]
        rows.append((i, body))
    rows += [(20, rows[2][1]), (21, rows[2][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in substring.dedup_passages(docs).collect()}
    assert [i for i in range(12) if i % 3 == 0 and got[i]["_words_cut"] == 0] == [0]
    assert all(got[i]["_words_cut"] >= 32 and got[i]["_keepers"] == [0] for i in (3, 6, 9))
    assert got[1]["_words_cut"] == 0 and all(got[i]["_words_cut"] == 40 and "short line" in got[i]["text"] for i in (4, 7, 10))
    assert all(got[i]["_words_cut"] == 0 and got[i]["text"] == dict(rows)[i] for i in (2, 5, 8, 11))
    assert got[20]["text"] == got[21]["text"] == "" and got[20]["_keepers"] == [2]


@pytest.mark.parametrize("n", [51, 60, 100])
def test_passages_inside_lines_go_whole(spark, n):
    rng = np.random.default_rng(n)
    shared = words(rng, n)
    own = {i: (words(rng, 40), words(rng, 40)) for i in range(12)}
    ends = {10: ([], own[10][1]), 11: (own[11][0], [])}
    rows = [(i, " ".join([*a, *shared, *b])) for i, (a, b) in (own | ends).items()]
    rows.append((12, " ".join(["other", *(w.upper() for w in shared), *own[0][1][:5], *words(rng, 90)])))
    got = {r["doc_id"]: r for r in substring.dedup_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0]["_words_cut"] == 0 and all(got[i]["_words_cut"] == n and got[i]["_keepers"] == [0] for i in range(1, 10))
    assert all(got[i]["text"].split() == [*own[i][0], *own[i][1]] for i in range(1, 10))
    assert got[10]["text"].split() == own[10][1] or got[10]["text"] == ""
    assert got[11]["text"].split() == own[11][0] or got[11]["text"] == ""
    assert got[12]["_words_cut"] == n + 5 and got[12]["text"].split()[0] == "other" and not {*own[0][1][:5]} & {*got[12]["text"].split()}


def test_paragraph_classes_match_brute_force(spark, docs):
    """All pairs of paragraphs by exact Jaccard similarity."""
    want = {(i, a) for i, spans in paragraph_losers({r["doc_id"]: r["text"] for r in docs.collect()}).items() for a, _ in spans}
    got = {(r["doc_id"], r["start"]) for r in substring.removals(docs, window=10**6).collect()}
    assert len(want - got) <= 0.01 * len(want) and got <= want and want


def test_passages_over_short_lines_are_found(spark):
    """One word differs, so no window of 32 words is shared; a run of short lines is a paragraph all the same."""
    rng = np.random.default_rng(8)
    lines = [words(rng, 11) for _ in range(5)]
    wrap = lambda ls: "\n".join(" ".join(x) for x in ls)
    other = [list(x) for x in lines]
    other[2][5] = "changed"
    own = [" ".join(words(rng, 60)) for _ in range(6)]
    texts = [f"{own[0]}\n{wrap(lines)}\n\n{own[3]}", f"{own[1]}\n\n{wrap(other)}\n{own[4]}", f"{own[2]}\n{wrap(lines[:2])}\n{own[5]}"]
    got = {r["doc_id"]: r for r in substring.dedup_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i]["_words_cut"] for i in range(3)] == [0, 55, 0] and got[1]["text"] == f"{own[1]}\n\n{own[4]}"


def test_what_stays_keeps_its_white_space():
    text = "a  b\tc   d e\n  x\n  f g  h  "
    assert substring.cut(text, [(1, 2)]) == ("a  d e\n  x\n  f g  h  ", 2)
    assert substring.cut(text, [(6, 1)]) == ("a  b\tc   d e\n  x\n  g  h  ", 1)
    assert substring.cut(text, [(4, 1), (8, 1)]) == ("a  b\tc   d\n  x\n  f g", 2)
    assert substring.cut(text, [(5, 1)]) == ("a  b\tc   d e\n  f g  h  ", 1)


def test_ids_with_several_texts_are_left_alone(spark):
    rng = np.random.default_rng(4)
    line = " ".join(words(rng, 40))
    rows = [(1, line), (2, line), (2, line + " more"), (3, line), (3, line)]
    got = sorted((r["doc_id"], r["_words_cut"]) for r in substring.dedup_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 0), (2, 0), (2, 0), (3, 40), (3, 40)]


def test_a_hub_and_a_family_are_spread_over_tasks(spark):
    """Far more members than one search takes, in one component."""
    star = spark.range(1, 6000).selectExpr("id as a", "0L as b").unionByName(spark.range(6000, 6010).selectExpr("id as a", "id - 1 as b"))
    got = {r["node"]: r["root"] for r in components(star).collect()}
    assert got == {i: 0 for i in range(1, 6010)}
    rows = spark.range(3000).selectExpr("7L as key", "id as node", "id as v").unionByName(spark.range(5000, 5010).selectExpr("8L as key", "id as node", "id as v"))
    cut = blocks._cut(rows, rows.groupBy("key").agg(F.count("*").alias("n")), 100)
    sizes = [r["count"] for r in cut.groupBy("key").count().collect()]
    assert max(sizes) < 200 and len(sizes) == 60 * 61 // 2 + 1


def test_null_ids_join_documents_and_repeats_are_chosen_in_order(spark):
    fps = [0, 0b111, 0b111111, 0xFF << 40]  # the second is near both of its neighbours
    links = {r["node"]: r["root"] for r in components(simhash.near_links(spark.createDataFrame([(f, f) for f in fps], "node long, fp long"))).collect()}
    assert links == {0b111: 0, 0b111111: 0}
    rows = [(5, "b", "x"), (5, "a", "z"), (5, "a", "y"), (5, None, "w"), (6, "c", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, doc string").withColumn("m", F.create_map(F.lit("k"), F.col("doc")))
    kept = {r["doc_id"]: (r["text"], r["doc"]) for r in simhash.keep_first(df).collect()}
    assert kept[5] == (None, "w")


def test_lists_are_split_without_losing_a_pair(spark):
    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 62, 60)
    fps = sorted({int(b) ^ sum(1 << int(k) for k in rng.integers(0, 62, rng.integers(0, 5))) for b in base for _ in range(8)})
    links = [(i, j) for i, j in itertools.combinations(range(len(fps)), 2) if (fps[i] ^ fps[j]).bit_count() <= 4]
    want = least(fps, links)
    points = spark.createDataFrame([(f, f) for f in fps], "node long, fp long")
    for most in (1, 1e-4, 1e-9):
        assert simhash.depth_of(len(fps), 4, most) > 1
        found = {r["node"]: r["root"] for r in components(simhash.near_links(points, most=most)).collect()}
        assert [found.get(f, f) for f in fps] == want


def test_substring_edge_cases(odd, none):
    got = substring.dedup_passages(odd)
    assert sorted(got.columns) == sorted(odd.columns) and got.count() == odd.count()  # result columns replace those of their name
    other = substring.dedup_passages(odd, keepers="k2", words_cut="w2")
    assert other.columns == [*odd.columns, "k2", "w2"] and other.where("_keepers <> 'x'").count() == 0
    assert substring.dedup_passages(none).count() == 0
    assert {r["_words_cut"] for r in got.where("doc_id is null or text is null").collect()} == {0}


@pytest.mark.parametrize("n", [0, 1, 19, 20, 51, 300])
def test_every_stretch_holds_a_minimiser(n):
    v = np.random.default_rng(n).integers(0, 50, n).astype(np.uint64)
    at = substring.minimisers(v, 20, np.zeros(n, np.int64))
    assert all(((at >= i) & (at < i + 20)).any() for i in range(max(0, n - 19))) and (len(at) > 0) == (n > 0)
