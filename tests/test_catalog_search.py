"""Catalogue search scores kinds of assets against sets of stems, not every text against every asset."""

from __future__ import annotations

from chronoweave.operators import catalog as ct

LABELS = ["red widget", "old bolt", "hot ring"]


def _tables(spark, n):
    assets = [(i, LABELS[i % 3], "small brand", 5 if i % 2 else 1) for i in range(n)]
    assets += [(0, "blue widget", "large", 5), (None, "red widget", "small", 5), (n, None, "small", 5), (n + 1, "red widget", "small brand", None), (n + 1, "red widget", "small brand", None)]
    queries = [(i, f"wid promo serial{i}") for i in range(n)] + [(n, None), (n, "zz"), (n + 1, "the red bolting sound"), (n + 1, "the red bolting sound"), (None, "bolts")]
    return (spark.createDataFrame(queries, "query_id long, text string"), spark.createDataFrame(assets, "asset_id long, label string, described string, quality int"), queries, assets)


def _brute(queries, assets, limit):
    import re
    def stems(t):
        return [re.sub(ct.SUFFIX, "", w) for w in re.split("[^a-z0-9]+", t.lower()) if len(w) >= 2 and w not in ct.STOP] if t is not None else []
    tags = {}
    for a, label, described, _ in assets:
        if a is not None and label is not None:
            for w, p in [(w, 3) for w in stems(label)] + [(w, 2) for w in stems(described)]:
                tags.setdefault(a, {})[w] = max(p, tags.get(a, {}).get(w, 0))
    out = []
    for qid, text in queries:
        rows = []
        for a, label, _, quality in assets:
            s = sum(max([p if w == q else 1 for w, p in tags.get(a, {}).items() if w.startswith(q) or q.startswith(w)], default=0) for q in set(stems(text)))
            s -= 2 if quality is not None and quality < ct.USABLE_QUALITY else 0
            if s > 0:
                rows.append((-s, label is not None, label or "", a))
        out += [(qid, k + 1, r[3], -r[0]) for k, r in enumerate(sorted(rows)[:limit])]
    return out


def test_search_equals_brute_force(spark):
    q, a, queries, assets = _tables(spark, 60)
    for limit in (1, 5, 40):
        got = [tuple(r) for r in ct.catalog_search(q, a, limit).collect()]
        assert sorted(got, key=str) == sorted(_brute(queries, assets, limit), key=str)


def test_texts_and_assets_alike_are_scored_once(spark):
    sizes = []
    for n in (60, 600):
        q, a, _, _ = _tables(spark, n)
        kinds = ct.asset_kinds(a)
        stems = kinds.selectExpr("explode(tags.stem) AS stem").distinct()
        asked = q.selectExpr("text").select(ct.F.explode(ct.stems(ct.F.col("text"))).alias("qs")).distinct()
        texts = ct.wanted_stems(q, ct.prefix_pairs(asked, stems, "qs", "stem"))
        sizes.append((kinds.select("kind").distinct().count(), texts.select("wanted").distinct().count()))
        assert kinds.groupBy("kind").count().agg({"count": "max"}).first()[0] <= ct.SEARCH_LIMIT
    assert sizes[0] == sizes[1]
