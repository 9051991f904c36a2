"""Small tables with every awkward case, and the brute-force versions that results are held against."""

import collections

LONG = "Lorem ipsum dolor sit amet consectetur. " * 4000


def odd_documents(spark):
    """Null and empty texts, a very long one, null fields, repeated rows and ids, a clashing column name."""
    text = "The quick brown fox jumps over the lazy dog near the quiet river bank today. " * 3
    rows = [
        (1, text, "en", "a", 0, "x"), (2, None, "en", "a", None, "x"), (3, "", None, None, 0, None), (4, text, "en", "b", 5, "x"), (4, text, "en", "b", 5, "x"),
        (5, LONG, "en", "b", 5, "x"), (None, text + "More words stand here.", "en", "c", 1, "x"), (6, "one two", "en", "c", 7, "x"), (7, "\n\n \t\n", "en", "c", 4, "x"),
        (8, "naïve café\nTHE END x", "fr", "", 9, "x"), (9, "one two", "en", "zz", 7, "x"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")


def no_documents(spark):
    return odd_documents(spark).filter("doc_id < 0")


def union_find(n, links):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in links:
        a, b = root(i), root(j)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def brute_classes(texts, counts, threshold=0.8):
    """Class of each text (index of its least member) by comparing all pairs that share a shingle."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    from kinweave.llm import neardup as nd
    from kinweave.llm import textvec as tv

    model, vec = nd.Model(counts), []
    for block in tv.blocks(pc.utf8_lower(pa.array([t or "" for t in texts], pa.string()))):
        s, owner, tf, _ = nd.shingles(block)
        w = model.weights(s, tf)
        bound = np.searchsorted(owner, np.arange(block.n + 1))
        vec += [dict(zip(s[i:j].tolist(), w[i:j].tolist(), strict=True)) for i, j in zip(bound[:-1], bound[1:], strict=True)]
    holders = collections.defaultdict(list)
    for i, v in enumerate(vec):
        for h in v:
            holders[h].append(i)
    links = set()
    for i, j in {(x[a], x[b]) for x in holders.values() for a in range(len(x)) for b in range(a + 1, len(x))}:
        low = sum(min(w, vec[j].get(h, 0)) for h, w in vec[i].items())
        if low >= threshold * (sum(vec[i].values()) + sum(vec[j].values()) - low):
            links.add((i, j))
    return union_find(len(texts), links)
