"""Catalogue search, matching and choice.

Text matching goes through inverted indexes over *distinct* stems and labels, so
the join sides are vocabularies; picks are ``min_by`` / ``max_by`` aggregates,
which combine before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.operators.staging import stage

# Stop lists, suffixes, limits and weights.
STOP = ["the", "a", "an", "of", "and", "sound", "sfx", "effect", "noise", "hit", "with"]
SUFFIX = r"(ing|ers|er|es|s|ed)$"
LABEL_STOP = ["the", "and", "for", "with", "shot", "stock", "video", "image", "photo", "footage", "clip", "of", "a", "an"]
SEARCH_LIMIT = 40
CREDIT_FREE = r"(?i)creative commons 0|publicdomain|cc0"
ALLOWED_LICENSE = r"(?i)creative commons 0|attribution"
USABLE_QUALITY = 3


def stems(text: Column) -> Column:
    words = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: (F.length(w) >= 2) & ~w.isin(*STOP))
    return F.transform(words, lambda w: F.regexp_replace(w, SUFFIX, ""))


def label_tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: (F.length(w) >= 3) & ~w.isin(*LABEL_STOP))


def _prefixes(x: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.length(x)), lambda n: F.substring(x, F.lit(1), n))


def prefix_pairs(left: DataFrame, right: DataFrame, l: str, r: str) -> DataFrame:
    """Distinct vocabulary pairs where one stem starts the other, by equi-joins on prefixes."""
    a = right.select(r, F.explode(_prefixes(F.col(r))).alias(l)).join(left.select(l), l).select(l, r)
    b = left.select(l, F.explode(_prefixes(F.col(l))).alias(r)).join(right.select(r), r).select(l, r)
    return a.unionByName(b).distinct()


def asset_kinds(assets: DataFrame, limit: int = SEARCH_LIMIT) -> DataFrame:
    """``kind, tags, flawed, place, asset_id, label``: assets with the same tags and flaw score alike for every query.

    Ties of a kind break by label and id, so only the first ``limit`` rows of a kind can come among the best
    ``limit`` of anything. Written once, as it is read several times.
    """
    tagged = F.concat(F.transform(stems(F.col("label")), lambda w: F.struct(w.alias("stem"), F.lit(3).alias("weight"))),
                      F.transform(stems(F.col("described")), lambda w: F.struct(w.alias("stem"), F.lit(2).alias("weight"))))
    index = assets.select("asset_id", F.explode(tagged).alias("t")).groupBy("asset_id", "t.stem").agg(F.max("t.weight").alias("weight"))
    tags = index.groupBy("asset_id").agg(F.sort_array(F.collect_list(F.struct("stem", "weight"))).alias("tags"))
    flawed = F.coalesce(F.col("quality") < USABLE_QUALITY, F.lit(False))
    w = Window.partitionBy("tags", "flawed").orderBy("label", "asset_id")
    kept = assets.select("asset_id", "label", flawed.alias("flawed")).join(tags, "asset_id").withColumn("place", F.row_number().over(w)).filter(F.col("place") <= limit)
    kept = stage(kept, "kinds")
    kinds = stage(kept.select("tags", "flawed").distinct().withColumn("kind", F.monotonically_increasing_id()), "kind")  # ids hold once written
    return kept.join(kinds, ["tags", "flawed"]).select("kind", "tags", "flawed", "place", "asset_id", "label")


def wanted_stems(queries: DataFrame, pairs: DataFrame) -> DataFrame:
    """``text, wanted``: a text's stems that meet the catalogue, sorted; texts alike in these have the same answer."""
    q = queries.select("text").distinct().select("text", F.explode(F.array_distinct(stems(F.col("text")))).alias("qs"))
    return q.join(pairs.select("qs").distinct(), "qs").groupBy("text").agg(F.sort_array(F.collect_list("qs")).alias("wanted"))


def catalog_search(queries: DataFrame, assets: DataFrame, limit: int = SEARCH_LIMIT) -> DataFrame:
    """Assets per query, best first: 3 for a name stem, 2 for a description stem, 1 for a prefix; flawed ones sink.

    ``queries`` has query_id, text; ``assets`` has asset_id, label, described, quality. Sets of wanted stems are scored
    against kinds of assets, once each: a word that thousands of texts and assets share does not pair them all.
    """
    members = stage(asset_kinds(assets, limit), "members")
    heads = members.filter("place = 1")
    index = heads.select("kind", F.explode("tags").alias("t")).select("kind", "t.stem", "t.weight")
    asked = queries.select(F.explode(stems(F.col("text"))).alias("qs")).distinct()
    pairs = stage(prefix_pairs(asked, index.select("stem").distinct(), "qs", "stem"), "pairs")
    texts = stage(wanted_stems(queries, pairs), "texts")
    hits = texts.select("wanted").distinct().select("wanted", F.explode("wanted").alias("qs")).join(pairs, "qs").join(index, "stem")
    hits = hits.withColumn("points", F.when(F.col("qs") == F.col("stem"), F.col("weight")).otherwise(1))
    scored = hits.groupBy("wanted", "kind", "qs").agg(F.max("points").alias("p")).groupBy("wanted", "kind").agg(F.sum("p").alias("s"))
    scored = scored.join(heads.select("kind", "flawed", "label", "asset_id"), "kind")
    scored = scored.withColumn("score", F.col("s") - F.when(F.col("flawed"), 2).otherwise(0)).filter("score > 0")
    w = Window.partitionBy("wanted").orderBy(F.desc("score"), "label", "asset_id")
    first = scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit).select("wanted", "kind", "score")
    best = first.join(members.select("kind", "label", "asset_id"), "kind")
    best = best.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= limit)
    return queries.join(texts, "text").join(best, "wanted").select("query_id", "rank", "asset_id", "score")


def best_label_match(queries: DataFrame, assets: DataFrame) -> DataFrame:
    """Asset whose label shares the most tokens with the query; the first asset wins ties, none at zero."""
    labels = assets.groupBy("label").agg(F.min("asset_id").alias("asset_id"))
    lt = labels.select("asset_id", F.explode(label_tokens(F.col("label"))).alias("tok"))
    qt = queries.select("text").distinct().select("text", F.explode(F.array_distinct(label_tokens(F.col("text")))).alias("tok"))
    n = qt.join(lt, "tok").groupBy("text", "asset_id").agg(F.count("*").alias("n"))
    best = n.groupBy("text").agg(F.min_by("asset_id", F.struct(-F.col("n"), "asset_id")).alias("asset_id"), F.max("n").alias("shared"))
    return queries.join(best, "text").select("query_id", "asset_id", "shared")


def alias_resolve(value: Column, entries: list[tuple[str, str]], aliases: dict[str, str]) -> Column:
    """Exact id, then squashed id or label, then alias; the registry is a literal map, not a join."""
    sq = lambda s: "".join(ch for ch in s.lower() if ch.isascii() and ch.isalnum())
    key = F.regexp_replace(F.lower(value), "[^a-z0-9]", "")
    exact, loose = {i: i for i, _ in entries}, {}
    for i, label in entries:
        loose.setdefault(sq(i), i)
        loose.setdefault(sq(label), i)
    m = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    return F.coalesce(F.try_element_at(m(exact), value), F.try_element_at(m(loose), key), F.try_element_at(m(aliases), key))


def fits_hd(w: Column, h: Column) -> Column:
    return (F.least(w, h) <= 1080) & (F.greatest(w, h) <= 1920)


def choose_rendition(files: DataFrame, key: str, fid: str, w: str, h: str) -> DataFrame:
    """Tallest rendition that fits HD, else the smallest; portrait files are the pool when there are any."""
    fit = fits_hd(F.col(w), F.col(h))
    rank = F.struct((F.col(h) < F.col(w)).alias("a"), (~fit).alias("b"), F.when(fit, -F.col(h)).otherwise(F.col(h)).alias("c"), F.when(fit, F.col(fid)).otherwise(-F.col(fid)).alias("d"))
    return files.groupBy(key).agg(F.min_by(F.struct(fid, w, h), rank).alias("f")).select(key, "f.*")


def interleave_sources(items: DataFrame, source: str, item: str, w: str, h: str, limit: int, per_source: int) -> DataFrame:
    """Round-robin over sources up to a limit, then portrait items first, order otherwise kept."""
    rn = F.row_number().over(Window.partitionBy(source).orderBy(item))
    top = items.withColumn("turn", rn).filter(F.col("turn") <= per_source).orderBy("turn", source).limit(limit)
    order = Window.orderBy((F.col(h) < F.col(w)).cast("int"), "turn", source)  # at most ``limit`` rows
    return top.withColumn("pos", F.row_number().over(order).cast("long")).select("pos", source, item)


def cover_scale(w: Column, h: Column) -> Column:
    return F.least(F.lit(1.0), w / 1080.0, h / 1920.0)


def pick_cover(items: DataFrame, key: str, item: str, w: str, h: str, sharp: float = 0.66) -> DataFrame:
    """First sharp portrait item, else first portrait one, else the first."""
    portrait = F.col(h) >= F.col(w)
    cls = F.when(portrait & (cover_scale(F.col(w), F.col(h)) >= sharp), 0).when(portrait, 1).otherwise(2)
    return items.groupBy(key).agg(F.min_by(F.struct(item, cls.alias("cls")), F.struct(cls, item)).alias("p")).select(key, "p.*")


def dedupe_by_source(existing: DataFrame, incoming: DataFrame, keys: list[str], item: str) -> DataFrame:
    """One asset per source id; an existing one wins over anything incoming."""
    both = existing.withColumn("__new", F.lit(0)).unionByName(incoming.withColumn("__new", F.lit(1)))
    return both.groupBy(*keys).agg(F.min_by(item, F.struct("__new", item)).alias(item))


def rated_then_any(items: DataFrame, key: str, item: str, rated: Column, quality: str, tries: int = 3) -> DataFrame:
    """First usable of the first ``tries`` candidates, rated ones first."""
    rn = F.row_number().over(Window.partitionBy(key).orderBy((~rated).cast("int"), item))
    top = items.withColumn("turn", rn).filter(F.col("turn") <= tries)
    ok = F.col(quality).isNull() | (F.col(quality) >= USABLE_QUALITY)
    return top.filter(ok).groupBy(key).agg(F.min_by(item, "turn").alias(item))


def license_split(df: DataFrame, license: str, name: Column, author: Column) -> DataFrame:
    """Allowed licences with their credit flag and attribution line."""
    needs = ~F.col(license).rlike(CREDIT_FREE)
    line = F.concat(F.lit('"'), name, F.lit('" by '), author, F.when(needs, F.concat(F.lit(" ("), F.col(license), F.lit(")"))).otherwise(" (CC0)"))
    return df.filter(F.col(license).rlike(ALLOWED_LICENSE)).withColumn("needs_credit", needs).withColumn("attribution", line)


def resolve_reference(items: DataFrame, known: DataFrame, provider: DataFrame, labels: DataFrame, owner: str, order: str, cap: int = 8, generated_cap: int = 3) -> DataFrame:
    """Give each item an asset: known id, generation (capped), one provider lookup per distinct query, label match, or a reason.

    ``items`` has owner, order, asset_id, generate, kind, query.
    """
    w = Window.partitionBy(owner).orderBy(order)
    top = items.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= cap)
    top = top.join(known.select("asset_id", F.lit(True).alias("is_known")), "asset_id", "left")
    gen = F.when(F.col("is_known").isNull() & F.col("generate"), 1)
    top = top.withColumn("g", F.sum(gen).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    top = top.withColumn("lookup", F.lower("query")).join(provider.select("kind", F.col("query").alias("lookup"), F.col("asset_id").alias("p_asset")), ["kind", "lookup"], "left")
    top = top.join(labels.select(F.col("query").alias("lookup"), F.col("asset_id").alias("l_asset")), "lookup", "left")
    found = F.when(F.col("is_known"), F.col("asset_id")).when(F.col("generate"), F.when(F.col("g") <= generated_cap, F.concat(F.lit("gen_"), F.col(order).cast("string")))).otherwise(F.coalesce("p_asset", "l_asset"))
    why = F.when(F.col("is_known").isNull() & F.col("generate") & (F.col("g") > generated_cap), "generation_cap").when(F.coalesce(F.col("is_known"), F.lit(False)) | F.col("generate"), None).when(
        F.coalesce("p_asset", "l_asset").isNull(), "no_media")
    return top.select(owner, order, found.alias("resolved"), why.alias("dropped"))


def merge_libraries(items: DataFrame, key: str, ready: Column, updated: str, order: str, fields: list[str]) -> DataFrame:
    """One item per id: ready beats not ready, then the newest, the first on ties."""
    return items.groupBy(key).agg(F.max_by(F.struct(*fields), F.struct(ready.alias("r"), F.col(updated).alias("u"), (-F.col(order)).alias("o"))).alias("__i")).select(key, "__i.*")


def default_chain(owners: DataFrame, items: DataFrame, owner: str, item: str, ready: Column, wanted: list[str]) -> DataFrame:
    """First of the wanted ids the owner really has, else its first ready item, else its first."""
    hits = owners.select(owner, F.posexplode(F.array(*[F.col(c) for c in wanted])).alias("pref", item)).join(items.select(owner, item), [owner, item])
    asked = hits.groupBy(owner).agg(F.min_by(item, "pref").alias("asked"))
    firsts = items.groupBy(owner).agg(F.min(F.when(ready, F.col(item))).alias("ready_id"), F.min(item).alias("first_id"))
    return owners.select(owner).join(asked, owner, "left").join(firsts, owner, "left").select(owner, F.coalesce("asked", "ready_id", "first_id").alias("chosen"))


def next_free_name(names: DataFrame, owner: str, name: str, base: str = "Outro") -> DataFrame:
    """Smallest unused ``base n`` per owner, case-insensitive; only the numbered names are kept per owner."""
    low = F.lower(F.trim(name))
    n = F.when(low == base.lower(), 1).otherwise(F.regexp_extract(low, f"^{base.lower()} (\\d+)$", 1).try_cast("long"))
    used = names.withColumn("n", n).groupBy(owner).agg(F.collect_set("n").alias("used"))
    free = F.array_min(F.array_except(F.sequence(F.lit(1).cast("long"), F.size("used") + F.lit(1).cast("long")), F.col("used")))
    return used.select(owner, F.when(free == 1, base).otherwise(F.concat(F.lit(base + " "), free.cast("string"))).alias("name"))


def preset_override(preset: Column, base: Column, override: Column) -> Column:
    """Override, else the scene's preset, else the clip's own look - per field."""
    return F.coalesce(override, preset, base)
