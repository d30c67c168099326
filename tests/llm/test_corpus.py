"""Token counts, LM scores, shards, decontamination and the pipeline."""

import collections
import math
import re
import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from hushframe.llm import decontaminate, lm, sharding
from hushframe.llm.queries import ORACLE_SQL, QUERIES
from hushframe.llm.token_counts import Rollup, count_words, deltas, inserts

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def test_rollup(spark, tmp_path, docs, odd, none):
    from pyspark.sql import functions as F

    r = Rollup(spark, str(tmp_path / "r"))
    assert r.totals().count() == 0
    feed = inserts(odd, "v1", count_words(F.col("text")))
    assert r.commit("a", feed) and not r.commit("a", feed) and r.commit("empty", inserts(none, "v1", F.lit(1)))
    total = lambda: {(x["source"], x["lang"], x["tokenizer"]): (x["docs"], x["tokens"]) for x in r.totals().collect()}
    before = total()
    assert before[(None, None, "v1")] == (2, 12) and sum(d for d, _ in before.values()) == odd.count()
    change = spark.createDataFrame([("revise", None, None, "v1", 20, 12), ("delete", "c", "fr", "v1", 4, None), ("insert", "n", None, "v1", None, None)], "op string, source string, lang string, tokenizer string, tokens long, old_tokens long")
    r.commit("b", change)
    after = total()
    assert after[(None, None, "v1")] == (2, 20) and after[("n", None, "v1")] == (1, 0)
    r.compact()
    assert total() == after and not r.commit("b", change)
    r.commit("c", change.where("op = 'insert'"))
    r.compact()
    r.vacuum()
    assert not r.commit("a", feed)
    assert total()[("n", None, "v1")] == (2, 0)
    with pytest.raises(Exception, match="unknown op"):
        deltas(change.withColumn("op", F.lit("x"))).collect()
    with pytest.raises(ValueError):
        r.commit("../x", change)


def test_commits_during_a_compaction_count_once(spark, tmp_path, monkeypatch):
    """Every place where another writer may come between: before the compaction's entry, before a commit's, after a vacuum."""
    one, two = Rollup(spark, str(tmp_path / "r")), Rollup(spark, str(tmp_path / "r"))
    feed = lambda n: spark.createDataFrame([("insert", "s", "l", "v", n, None)], "op string, source string, lang string, tokenizer string, tokens long, old_tokens long")
    total = lambda: [(r["docs"], r["tokens"]) for r in one.totals().collect()]
    assert one.commit("a", feed(5))
    claim = one._claim

    def late(then):
        def run(version, entry):
            monkeypatch.setattr(one, "_claim", claim)
            then()
            return claim(version, entry)

        monkeypatch.setattr(one, "_claim", run)

    late(lambda: two.commit("b", feed(10)))
    one.compact()
    assert total() == [(2, 15)] and not one.commit("b", feed(10))
    late(lambda: two.commit("c", feed(100)))
    assert not one.commit("c", feed(100)) and total() == [(3, 115)]  # the same batch by two writers

    def folded():
        two.commit("d", feed(1000))
        two.compact()
        two.vacuum()

    late(folded)
    assert one.commit("e", feed(10_000)) and total() == [(5, 11_115)]  # its number was taken and vacuumed
    for r in (one, two):
        r.compact()
        r.vacuum()
    assert total() == [(5, 11_115)] and not any(one.commit(b, feed(1)) for b in "abcde")
    assert one.commit("f", feed(1)) and total() == [(6, 11_116)]


def test_token_versions_by_bpe(spark, tmp_path, docs):
    from pyspark.sql import functions as F

    from hushframe.llm import bpe
    from hushframe.llm.queries import tokenizer

    counted = docs.join(bpe.round_trip(docs, tokenizer()).select("doc_id", "n_tokens"), "doc_id")
    r = Rollup(spark, str(tmp_path / "r"))
    r.commit("bpe", inserts(counted, "byte_bpe_50k", F.col("n_tokens")))
    got = {(x["source"], x["lang"]): x["tokens"] for x in r.totals().collect()}
    want = counted.groupBy("source", "lang").agg(F.sum("n_tokens").alias("n")).collect()
    assert got == {(x["source"], x["lang"]): x["n"] for x in want}


def reference_scores(rows):
    tokens = {i: [*WORD.findall((t or "").encode().lower()), b" "] for i, t in rows}
    c = collections.Counter()
    for i, ws in tokens.items():
        if zlib.crc32(str(i).encode()) % 10:
            c.update(ws)
    n, v = sum(c.values()), len(c)
    return {i: (len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) for i, ws in tokens.items()}


def test_lm(docs, odd, none, monkeypatch):
    monkeypatch.setattr(lm, "BATCH", 20_000)
    monkeypatch.setattr(lm, "RANGE", 30_000)
    want = reference_scores(docs.select("doc_id", "text").collect())
    got = lm.score(docs).toPandas()
    for r in got.itertuples():
        n, known, total, base = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total) and math.isclose(r.base_score, base, rel_tol=1e-9)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0)
    held = got[got["held_out"]]
    assert held["score"].sum() > held["base_score"].sum()
    out = lm.score(odd).toPandas()
    assert len(out) == odd.count() and np.isfinite(out["score"]).all() and lm.score(none).count() == 0


def counted(rows):
    """Training and deleted-fold counts of words and word pairs, by plain counters."""
    out = {k: (collections.Counter(), collections.Counter()) for k in ("train", "deleted")}
    tokens = {}
    for i, t in rows:
        ws = [*WORD.findall((t or "").encode().lower()), b" "]
        tokens[i] = list(zip([b" ", *ws[:-1]], ws, strict=True))
        fold = zlib.crc32(str(i).encode()) % lm.FOLDS
        for k in (["train"] if fold else []) + (["deleted"] if fold == lm.DELETED else []):
            out[k][0].update(ws)
            out[k][1].update(tokens[i])
    return tokens, out


def bucket(c):
    return c.bit_length()


def test_lm_scores_follow_the_formula_and_the_weights_are_those_of_em(spark, docs, monkeypatch):
    """The mixture recomputed from plain counts; the weights from expectation-maximisation over single events, without a histogram."""
    monkeypatch.setattr(lm, "BATCH", 20_000)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    tokens, c = counted(rows)
    (one, two), (gone1, gone2) = c["train"], c["deleted"]
    n = sum(one.values())
    kept = n - sum(gone1.values())
    events = collections.defaultdict(list)  # by bucket of the context: (pair estimate, word estimate)
    for pair, times in gone2.items():
        u, w = pair
        ku, kw, kp = one[u] - gone1[u], one[w] - gone1[w], two[pair] - gone2[pair]
        events[bucket(ku)].append((times, kp / max(ku, 1), kw / kept if kw else None))

    def em(part, prior, weight):
        lam = prior
        for _ in range(60):
            got = np.zeros(3)
            for times, p2, p1 in part:
                if p1 is None:
                    got[2] += times
                else:
                    a, b = lam[0] * p2, lam[1] * p1
                    got += times * np.array([a, b, 0]) / (a + b)
            lam = (got + weight * prior) / (got + weight * prior).sum()
        return lam

    whole = em([e for part in events.values() for e in part], np.array([0.3, 0.6, 0.1]), 1.0)
    want = {b: em(part, whole, 2.0) for b, part in events.items()}
    found = {}
    inner = lm.weights
    monkeypatch.setattr(lm, "weights", lambda *a, **k: found.setdefault("lam", inner(*a, **k)))
    scores = {r["doc_id"]: r["score"] for r in lm.score(docs).collect()}
    lam = found["lam"]
    assert all(np.abs(lam[b] - w).max() < 0.02 for b, w in want.items() if b and sum(e[0] for e in events[b]) > 200)
    for i, pairs in tokens.items():
        total = 0.0
        for u, w in pairs:
            a = lam[bucket(one[u])]
            total += math.log10(a[0] * two[u, w] / max(one[u], 1) + a[1] * one[w] / n + a[2] * (one[w] == 0))
        assert math.isclose(scores[i], total, rel_tol=1e-9)


def test_lm_weights_sum_to_one(docs):
    coded = lm.encode(docs)
    from hushframe.llm.kit import table

    coded = table(coded, "coded")
    one, two = lm.totals(coded, 1, 10), lm.totals(coded, 2, 10)
    lam = lm.weights(lm._joined(coded, one, two), 1000)
    assert np.allclose(lam.sum(axis=1), 1) and (lam >= 0).all() and (lam[1:] > 0).all()


def test_packing_is_lossless():
    rng = np.random.default_rng(0)
    for top in (10, 1 << 40, (1 << 64) - 1):
        k = np.unique(rng.integers(0, top, 50, dtype=np.uint64))
        assert (lm._unpack(lm._pack(k)) == k).all()
    for v in ([], [3], [300], [70_000], [1 << 40]):
        assert lm._large(lm._small(np.array(v, np.int64))).tolist() == v


def test_shards(docs, odd, none):
    got = sharding.shard(docs).toPandas().merge(docs.toPandas()[["doc_id", "text"]], on="doc_id")
    assert (got["size"] == got["text"].map(lambda t: len(t.encode()) + 16)).all() and (got["text_crc32"] == got["text"].map(lambda t: zlib.crc32(t.encode()))).all()
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    few = sharding.shard(docs, shards=4).toPandas()
    assert sharding.spread(few.groupby("shard")["size"].sum()) < 0.02 and few["shard"].nunique() == 4
    split = got.groupby("text").filter(lambda g: g["shard"].nunique() > 1).groupby("text")  # only what fills half a shard
    assert all(g["size"].sum() > got["size"].sum() / 80 or len(g) > len(got) / 80 for _, g in split)
    out = sharding.shard(odd, shards=3).toPandas()
    assert len(out) == odd.count() and set(out.query("doc_id == 3")["size"]) == {16} and sharding.shard(none).count() == 0


def test_a_hot_group_is_spread(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, 'the same text here', concat('own text ', id)) as text")
    got = sharding.shard(docs).toPandas()
    assert sharding.spread(got.groupby("shard")["size"].sum()) < 0.1


def test_containment_matches_brute_force(spark, docs, odd, none):
    rng = np.random.default_rng(5)
    items = [[f"i{j}w{rng.integers(1000)}" for j in range(n)] for n in (3, 8, 30, 120)]
    own = lambda n: [f"d{rng.integers(10**6)}" for _ in range(n)]
    texts = []
    for it in items:
        half = it[: len(it) // 2]
        edited = [w if k != len(it) - 1 else "zz" for k, w in enumerate(it)]
        texts += [own(50) + it + own(3000), own(20) + half + own(20), it, own(9) + edited + own(9), own(5) + [w.upper() + "," for w in it]]
    d = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)] + [(90, None), (91, ""), (None, " ".join(items[1]))], "doc_id long, text string")
    b = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)] + [(50, None), (51, ""), (None, "x"), (2, " ".join(items[2]))], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(d, b).collect()}
    norm = lambda t: [w for w in re.split(r"[\W_]+", t.lower()) if w]
    sh = lambda ws: {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()
    want = {(i, j) for i, t in enumerate(texts) for j, it in enumerate(items) if len(sh(norm(" ".join(it))) & sh(norm(" ".join(t)))) >= 0.8 * len(sh(norm(" ".join(it))))}
    assert got == want and {(5, 1), (10, 2), (15, 3)} <= got and (0, 0) not in got  # three words are no evidence
    assert decontaminate.contaminated(odd, b).count() == 0 and decontaminate.contaminated(none, b).count() == 0 and decontaminate.contaminated(d, b.limit(0)).count() == 0
    left = decontaminate.clean(odd, b)
    assert left.columns == odd.columns and left.count() == odd.count()


def test_native_plans_hold_no_python(spark, sf, docs):
    plan = decontaminate.contaminated(docs, spark.read.parquet(f"{sf}/benchmark.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql_forms(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = QUERIES[name](spark, sf).toPandas(), con.execute(ORACLE_SQL[name]).fetchdf()
    rows = lambda df: sorted(map(str, df[sorted(df.columns)].values.tolist()))
    assert rows(got) == rows(want)


def test_pipeline(spark, sf, docs):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    now, seen = docs, []
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, sf)
        seen.append(out)
        now = out
    assert all(s.columns == docs.columns for s in seen[:4]) and "ids_sha256" in seen[4].columns
    ids = [{r["doc_id"] for r in s.select("doc_id").collect()} for s in seen]
    assert ids[0] > ids[1] and ids[1] >= ids[2] > ids[3] and ids[3] == ids[4]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(r["text"] == texts[r["doc_id"]] for r in seen[1].collect())
    assert all(r["n_chars"] == len(r["text"]) for r in seen[2].collect())
    assert decontaminate.contaminated(seen[3], spark.read.parquet(f"{sf}/benchmark.parquet")).count() == 0
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, sf).select("doc_id").collect()} == ids[4]


def test_pipeline_matches_brute_force(spark, sf, docs):
    """Each stage's decisions recomputed from its own input, pair by pair."""
    import hashlib

    from tests_near import near_classes, paragraph_losers
    from tokenizers import Tokenizer

    from hushframe.llm import quality
    from hushframe.llm.queries import tokenizer

    as_dict = lambda df: {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality rules"](spark, docs, sf)
    verdict = quality.assess(docs, spark.read.parquet(f"{sf}/labels.parquet")).where("kept").select("doc_id").collect()
    assert set(as_dict(kept)) == {r["doc_id"] for r in verdict}
    first = stages["SimHash near-dedup"](spark, kept, sf)
    classes = near_classes(as_dict(kept))
    assert as_dict(first) == {i: t for i, t in as_dict(kept).items() if classes[i] == i}
    cut = stages["substring dedup"](spark, first, sf)
    before, after = as_dict(first), as_dict(cut)
    lost = paragraph_losers(before)
    for i, t in before.items():
        for a, b in lost.get(i, ()):  # the words of a paragraph that an earlier one matches are gone
            assert len((after.get(i) or "").split()) <= len(t.split()) - (b - a)
    shared = collections.Counter(w for t in before.values() for w in {tuple(t.lower().split()[k : k + 32]) for k in range(len(t.split()) - 31)})
    for i, t in before.items():
        if i not in lost and all(shared[tuple(t.lower().split()[k : k + 32])] == 1 for k in range(len(t.split()) - 31)):
            assert after[i] == t  # nothing is shared, nothing goes
    clean = stages["benchmark decontamination"](spark, cut, sf)
    norm = lambda t: [w for w in re.split(r"[\W_]+", t.lower()) if w]
    sh = lambda ws: {tuple(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))} if ws else set()
    items = [sh(norm(r["text"])) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    bad = {i for i, t in after.items() for it in items if it and len(it & sh(norm(t))) >= 0.8 * len(it)}
    assert set(as_dict(clean)) == set(after) - bad
    lib = Tokenizer.from_file(tokenizer())
    for r in stages["BPE encoding and decoding"](spark, clean, sf).collect():
        ids = lib.encode(after[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_pipeline_stages_take_odd_rows(spark, sf, odd, none):
    for _, stage in corpus_pipeline.STAGES:
        for df in (odd, none):
            out = stage(spark, df, sf)
            assert out.count() >= 0 and (out.columns == df.columns or "ids_sha256" in out.columns)
