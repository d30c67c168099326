"""The plan language: parse, validate, lower to a lazy DataFrame, execute under the policy."""
