"""Short texts whose only partner is a text with a word more, against brute force over all pairs."""

import pytest

from quire.llm.op10_prefix_tree_join import classes_and_components, sketch_size


def shingles(text, k):
    w = text.split()
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)}


def brute(rows, k, percent):
    sets = [(i, shingles(t, k)) for i, t in rows]
    up = {i: i for i, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, (i, s) in enumerate(sets):
        for j, u in sets[:a]:
            if 100 * len(s & u) >= percent * len(s | u):
                x, y = sorted((find(i), find(j)))
                up[y] = x
    return sorted((i, len(s), find(i)) for i, s in sets)


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80)])
def test_texts_with_a_word_more_match_brute_force(spark, k, percent):
    texts = []
    for n in range(4, 13):
        base = [f"w{n}x{j}" for j in range(n)]
        groups = ([base, base + ["z"]], [base, ["a"] + base], [base, ["a"] + base + ["z"]],
                  [base + ["z"], base, ["a"] + base])            # the short text is a bridge
        texts += [" ".join(f"g{g}{w}" for w in t) for g, group in enumerate(groups) for t in group]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in classes_and_components(df, k, percent).collect())
    assert got == brute(rows, k, percent)


@pytest.mark.parametrize("percent", [80, 85])
def test_every_size_that_can_link_has_a_sketch(percent):
    for n in range(1, 400):                                      # the nearest other set has one shingle more
        assert (sketch_size(n, percent) > 0) == (100 * n >= percent * (n + 1))
