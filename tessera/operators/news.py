"""Dated, geocoded events against places and months, as of their publication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.config import DEFAULT, NewsConfig
from tessera.operators.quantiles import quantile
from tessera.storage import materialize

#: Sentence ends, as a lookbehind split.
SENTENCE = r"(?<=[.!?;])\s+"


def tokens(text: Column) -> Column:
    """Lower-case ASCII words."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))


def padded(text: Column) -> Column:
    """Tokens joined by single spaces with one at either end: a phrase is found as `` phrase ``."""
    return F.concat(F.lit(" "), F.concat_ws(" ", tokens(text)), F.lit(" "))


def typed(text: Column, rules: dict[str, tuple[str, ...]]) -> Column:
    """All event types of which a trigger word or phrase occurs. The text is tokenised once for all rules."""
    kinds = lambda p: F.array(*[F.when(_any([p.contains(f" {w} ") for w in words]), F.lit(kind)) for kind, words in rules.items()])
    return F.array_compact(F.flatten(F.transform(F.array(padded(text)), kinds)))


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def sentences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(id_col, F.posexplode(F.split(text_col, SENTENCE)).alias("sentence_no", "sentence"))


def geocode(texts: DataFrame, gazetteer: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, territory_id, region_code``: places named in texts by the gazetteer ``term, territory_id, region_code`` (a term with a null
    territory names a region). A term of several territories counts only where the text names one of their regions.

    Words are exploded once and met with the gazetteer, a dimension table that Spark may broadcast by its size.
    """
    words = texts.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(tokens(F.col(text_col)))).alias("term"))
    named = materialize(words.join(gazetteer, "term").distinct(), "named")
    places, areas = named.where("territory_id is not null"), named.where("territory_id is null").select("id", "region_code").distinct()
    homonyms = gazetteer.where("territory_id is not null").groupBy("term").agg(F.countDistinct("territory_id").alias("n_places"))
    places = places.join(homonyms, "term")
    sure = places.where("n_places = 1").select("id", "territory_id", "region_code")
    resolved = places.where("n_places > 1").join(areas, ["id", "region_code"], "left_semi").select("id", "territory_id", "region_code")
    only = areas.select("id", F.lit(None).cast("int").alias("territory_id"), "region_code").join(sure.unionByName(resolved).select("id", "region_code").distinct(), ["id", "region_code"], "left_anti")
    return sure.unionByName(resolved).unionByName(only.select("id", "territory_id", "region_code")).distinct()


#: What a name is made of, in lower case: letters, digits, the underscore and the number sign.
NAME_TOKEN = r"[\p{L}\p{N}_#]+"


def name_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(NAME_TOKEN), F.lit(0))


def build_gazetteer(places: DataFrame, regions: DataFrame, stop: DataFrame | None = None) -> DataFrame:
    """``phrase, n, territory_id, region_code`` from names: ``places(name, territory_id, region_code)`` and ``regions(name, region_code)``
    (rows with a null territory). A phrase is a name's tokens joined by spaces, ``n`` their number; names in ``stop(name)``,
    names without a token and repeated rows are left out."""
    names = places.select("name", "territory_id", "region_code").unionByName(regions.select("name", F.lit(None).cast(places.schema["territory_id"].dataType).alias("territory_id"), "region_code"))
    words = names.withColumn("_w", name_tokens(F.col("name")))
    out = words.select(F.concat_ws(" ", "_w").alias("phrase"), F.size("_w").alias("n"), "territory_id", "region_code").where("n > 0").distinct()
    if stop is not None:
        out = out.join(stop.select(F.concat_ws(" ", name_tokens(F.col("name"))).alias("phrase")), "phrase", "left_anti")
    return out


def phrase_matches(sentences: DataFrame, gazetteer: DataFrame, keys: list[str], text_col: str = "sentence") -> DataFrame:
    """``*keys, start, n, phrase, territory_id, region_code``: names in sentences, the longest ones: a match inside a longer one doesn't count.

    Token n-grams as long as the gazetteer's names are exploded once and met with it by equality; how long they may be is one number.
    """
    longest = gazetteer.agg(F.max("n")).first()[0] or 0
    tokens_ = sentences.select(*keys, name_tokens(F.col(text_col)).alias("_w"))
    at = F.posexplode(F.col("_w")).alias("start", "_first")
    grams = tokens_.select(*keys, "_w", at).select(*keys, "start", F.explode(F.sequence(F.lit(1), F.least(F.lit(max(longest, 1)), F.size("_w") - F.col("start")))).alias("n"), "_w")
    grams = grams.select(*keys, "start", "n", F.concat_ws(" ", F.slice("_w", F.col("start") + 1, F.col("n"))).alias("phrase"))
    found = grams.join(gazetteer, ["phrase", "n"])
    order = Window.partitionBy(*keys).orderBy("start", F.desc("n"))
    spans = found.select(*keys, "start", "n").distinct()
    before = F.max(F.col("start") + F.col("n")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    kept = spans.withColumn("_before", before).where(F.col("_before").isNull() | (F.col("_before") < F.col("start") + F.col("n"))).drop("_before")
    return found.join(kept, [*keys, "start", "n"])


def geocode_sentences(docs: DataFrame, gazetteer: DataFrame, pattern: str, id_col: str = "id", text_col: str = "text", region_col: str = "region_code") -> DataFrame:
    """``id, territory_ids, region_codes``: places that a document names in sentences that match ``pattern``, in its own region only; where
    there is none, the region.

    A name of several places counts only where its region says which one it is: homonyms inside the document's region are
    dropped. Documents without a matching sentence get their region too; null texts have no sentence.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(region_col).alias("own_region"))
    s = sentences(docs, "id", "text").where(F.col("sentence").rlike(pattern))
    found = phrase_matches(s, gazetteer, ["id", "sentence_no"]).where("territory_id is not null")
    found = found.join(docs.select("id", "own_region"), "id").where(F.col("region_code") == F.col("own_region"))
    one = found.groupBy("id", "sentence_no", "start").agg(F.min("territory_id").alias("territory_id"), F.max("territory_id").alias("_other")).where(F.col("territory_id") == F.col("_other"))
    named = one.groupBy("id").agg(F.array_sort(F.collect_set("territory_id")).alias("territory_ids"))
    out = docs.select("id", "own_region").join(named, "id", "left")
    none = F.col("territory_ids").isNull()
    kind = dict(gazetteer.dtypes)["territory_id"]
    return out.select("id", F.when(none, F.array().cast(f"array<{kind}>")).otherwise(F.col("territory_ids")).alias("territory_ids"), F.when(none, F.array("own_region")).otherwise(F.array().cast(f"array<{dict(docs.dtypes)['own_region']}>")).alias("region_codes"))


def lag_weight(lag: Column, date: Column, cfg: NewsConfig = DEFAULT.news) -> Column:
    """Share of the month that is left in the event's own month, 1 in the next, then halved every ``half_life`` months."""
    days = F.dayofmonth(F.last_day(date))
    own = (days - F.dayofmonth(date) + 1) / days
    return F.when(lag == 0, own).otherwise(F.pow(F.lit(0.5), (lag - 1) / cfg.half_life))


def monthly_exposure(events: DataFrame, regions: DataFrame, cfg: NewsConfig = DEFAULT.news) -> DataFrame:
    """Events ``event_id, date, types, territory_ids, region_codes`` to ``territory_id, type, month, exposure``.

    A mentioned territory has weight 1, each territory of a mentioned region ``region_weight``; of both, the larger
    counts (an event that names a place and its region is one event). The range join of events to months is an
    explode of few lags and an equi-join. Nothing reaches back before the publication day.
    """
    e = events.withColumn("date", F.date_add("date", cfg.publication_lag_days))
    own = e.select("event_id", "date", "types", F.explode("territory_ids").alias("territory_id"), F.lit(1.0).alias("w"))
    area = e.select("event_id", "date", "types", F.explode("region_codes").alias("region_code")).join(regions.select("territory_id", "region_code"), "region_code")
    rows = own.unionByName(area.select("event_id", "date", "types", "territory_id", F.lit(cfg.region_weight).alias("w")))
    rows = rows.groupBy("event_id", "date", "types", "territory_id").agg(F.max("w").alias("w"))
    rows = rows.withColumn("type", F.explode("types")).withColumn("lag", F.explode(F.sequence(F.lit(0), F.lit(cfg.max_lag))))
    month = F.add_months(F.trunc("date", "MM"), F.col("lag"))
    return rows.groupBy("territory_id", "type", month.alias("month")).agg(F.sum(F.col("w") * lag_weight(F.col("lag"), F.col("date"), cfg)).alias("exposure"))


def exposure_without(events: DataFrame, regions: DataFrame, source_col: str = "source", cfg: NewsConfig = DEFAULT.news) -> DataFrame:
    """``territory_id, month, source, exposure, without``: each source's share of the exposure, and what the other sources leave.

    Groups that one source defines can so be tested with a hazard that it didn't define. A source is met as the type of its
    events, so exposures of all sources come from one pass; rows are those to which a source contributes, for others nothing changes.
    """
    by = monthly_exposure(events.withColumn("types", F.array(F.col(source_col).cast("string"))), regions, cfg).withColumnRenamed("type", "source")
    return by.withColumn("without", F.sum("exposure").over(Window.partitionBy("territory_id", "month")) - F.col("exposure"))


def hazard_multiplier(panel: DataFrame, exposure: DataFrame, cfg: NewsConfig = DEFAULT.news) -> DataFrame:
    """The panel with ``mult`` = 1 + beta * min(exposure of hazard types, cap), 1 elsewhere."""
    some = exposure.where(F.col("type").isin(*cfg.hazard_types)).groupBy("territory_id", "month").agg(F.sum("exposure").alias("_x"))
    return panel.join(some, ["territory_id", "month"], "left").withColumn("mult", 1 + cfg.beta * F.least(F.coalesce("_x", F.lit(0.0)), F.lit(cfg.cap))).drop("_x")


def near_alarms(alarms: DataFrame, events: DataFrame, regions: DataFrame) -> DataFrame:
    """Alarms ``territory_id, category, month`` with up to two events of the own territory and one of its region within a month
    either side: the offset is exploded, so this is an equi-join."""
    from pyspark.sql.window import Window

    a = alarms.withColumn("_m", F.explode(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda k: F.add_months("month", k))))
    e = events.withColumn("_m", F.trunc("date", "MM"))
    own = e.select("event_id", "date", "_m", F.explode("territory_ids").alias("territory_id")).withColumn("rank_limit", F.lit(2))
    area = e.select("event_id", "date", "_m", F.explode("region_codes").alias("region_code")).join(regions.select("territory_id", "region_code"), "region_code")
    every = own.unionByName(area.select("event_id", "date", "_m", "territory_id").withColumn("rank_limit", F.lit(1)))
    rows = a.join(every, ["territory_id", "_m"])
    r = F.row_number().over(Window.partitionBy("territory_id", "category", "month", "rank_limit").orderBy("date", "event_id"))
    rows = rows.withColumn("_r", r).where(F.col("_r") <= F.col("rank_limit"))
    return rows.groupBy("territory_id", "category", "month").agg(F.concat_ws(" || ", F.array_sort(F.collect_set(F.col("event_id").cast("string")))).alias("events"))


def correction(rows: DataFrame) -> DataFrame:
    """Slope through the origin of forecast errors on exposure: validation rows ``x, e`` to ``beta``."""
    return rows.agg((F.sum(F.col("x") * F.col("e")) / F.greatest(F.sum(F.col("x") ** 2), F.lit(1e-9))).alias("beta"))


def event_study(z: DataFrame, treated: DataFrame, regions: DataFrame) -> DataFrame:
    """Rows ``territory_id, t, z`` as named (treated that month), in a region with a named one, or the rest: count and median by month."""
    reg = regions.select("territory_id", "region_code")
    rows = z.join(reg, "territory_id")
    named = treated.select("territory_id", "t").distinct().withColumn("_n", F.lit(True))
    areas = treated.select("territory_id", "t").distinct().join(reg, "territory_id").select("region_code", "t").distinct().withColumn("_a", F.lit(True))
    rows = rows.join(named, ["territory_id", "t"], "left").join(areas, ["region_code", "t"], "left")
    group = F.when(F.col("_n"), "named").when(F.col("_a"), "same_region").otherwise("rest")
    rows = materialize(rows.select("t", group.alias("grp"), "z"), "groups")
    return quantile(rows, ["t", "grp"], "z", 0.5, "median_z").join(rows.groupBy("t", "grp").agg(F.count("z").alias("n")), ["t", "grp"])
