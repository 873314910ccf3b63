"""Projections, representations, ordering, paging and linked entities."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meridion.operators.filters import in_dataset, live

#: Members that say nothing of an entity by themselves.
MINIMAL = ("@context", "createdAt", "modifiedAt")
SYSTEM = ("createdAt", "modifiedAt", "deletedAt", "expiresAt")


def pick(attribute: DataFrame, names: Iterable[str]) -> DataFrame:
    return attribute.where(F.col("attribute_name").isin(list(names)))


def omit(attribute: DataFrame, names: Iterable[str]) -> DataFrame:
    return attribute.where(~F.col("attribute_name").isin(list(names)))


def dataset_view(attribute: DataFrame, datasets: Iterable[str]) -> DataFrame:
    """Instances of the datasets; attributes left without one are gone."""
    return attribute.where(in_dataset(datasets))


def documents(attribute: DataFrame) -> DataFrame:
    """The current document of each entity: a map from attribute name to its instances, in order of dataset and language."""
    instance = F.struct("dataset_id", "lang", "attribute_type", "num", "str")
    per_name = attribute.where(live()).groupBy("entity_id", "attribute_name").agg(F.sort_array(F.collect_list(instance)).alias("instances"))
    return per_name.groupBy("entity_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("attribute_name", "instances")))).alias("document"))


def picked_document(document: DataFrame, pick_names: list[str] | None = None, omit_names: list[str] | None = None) -> DataFrame:
    """Picked and omitted members of a document; entities with only minimal members left are dropped."""
    keep = lambda k, _: (k.isin(pick_names) if pick_names else F.lit(True)) & (~k.isin(omit_names) if omit_names else F.lit(True))
    out = document.withColumn("document", F.map_filter("document", keep))
    return out.where(F.size(F.filter(F.map_keys("document"), lambda k: ~k.isin(list(MINIMAL)))) > 0)


def _plain(i: Column) -> Column:
    return F.coalesce(i["num"].cast("string"), i["str"])


def _languages(instances: Column) -> Column:
    """A map from each language of the instances to its first value."""
    lang = lambda i: F.coalesce(i["lang"], F.lit("@none"))
    names = F.array_distinct(F.transform(instances, lang))
    return F.map_from_arrays(names, F.transform(names, lambda n: _plain(F.get(F.filter(instances, lambda i: lang(i) == n), F.lit(0)))))


def simplified(document: DataFrame) -> DataFrame:
    """Key-values: one instance is its value; a multilingual attribute a map of languages; several datasets a map of them.

    Datasets come first, languages within each; of several values of one dataset and language the first in order counts.
    """

    def unwrap(_: Column, instances: Column) -> Column:
        first = F.get(instances, F.lit(0))
        dataset = lambda i: F.coalesce(i["dataset_id"], F.lit("@none"))
        names = F.array_distinct(F.transform(instances, dataset))
        of = lambda name: F.filter(instances, lambda i: dataset(i) == name)
        by_dataset = F.map_from_arrays(names, F.transform(names, lambda n: _plain(F.get(of(n), F.lit(0)))))
        lang_by_dataset = F.map_from_arrays(names, F.transform(names, lambda n: F.create_map(F.lit("languageMap"), _languages(of(n)))))
        language = first["attribute_type"] == "LanguageProperty"
        return (
            F.when(language & (F.size(names) == 1), F.to_json(F.create_map(F.lit("languageMap"), _languages(instances))))
            .when(language, F.to_json(F.create_map(F.lit("dataset"), lang_by_dataset)))
            .when(F.size(instances) > 1, F.to_json(F.create_map(F.lit("dataset"), by_dataset)))
            .otherwise(_plain(first))
        )

    return document.withColumn("document", F.transform_values("document", unwrap))


def in_language(attribute: DataFrame, ranges: list[str]) -> DataFrame:
    """Language properties as plain ones in the best language: the first range that has a value, else the first by name.

    A range matches a language that equals it or continues it after a hyphen; ``*`` matches any. The language that was
    chosen stays in ``lang``.
    """
    rank = F.lit(len(ranges))
    for i, r in reversed(list(enumerate(ranges))):
        hit = F.lit(True) if r == "*" else (F.lower("lang") == r.lower()) | F.lower("lang").startswith(r.lower() + "-")
        rank = F.when(hit, F.lit(i)).otherwise(rank)
    language = F.col("attribute_type") == "LanguageProperty"
    best = F.row_number().over(W.partitionBy("entity_id", "attribute_name", "dataset_id").orderBy(rank, "lang"))
    chosen = attribute.where(language).withColumn("__n", best).where("__n = 1").drop("__n").withColumn("attribute_type", F.lit("Property"))
    return attribute.where(~language).unionByName(chosen)


def without_system(columns: Iterable[str], keep: str | None = None) -> list[str]:
    names = {"createdAt": "created_at", "modifiedAt": "modified_at", "deletedAt": "deleted_at", "expiresAt": "expires_at"}
    drop = {names[m] for m in SYSTEM if m != keep}
    return [c for c in columns if c not in drop]


def geojson(entity: DataFrame) -> DataFrame:
    """``(entity_id, feature)``: a GeoJSON feature of the entity's place."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), F.col("entity_id").alias("id"), geometry.alias("geometry"), F.struct(F.col("types").alias("type")).alias("properties"))
    return entity.select("entity_id", F.to_json(feature).alias("feature"))


def renamed(attribute: DataFrame, terms: dict[str, str], back: bool = False) -> DataFrame:
    """Terms to IRIs, or back; names without an entry stay. The context is a literal map, so no join is needed."""
    table = {v: k for k, v in terms.items()} if back else terms
    lookup = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return attribute.withColumn("attribute_name", F.coalesce(F.try_element_at(lookup, F.col("attribute_name")), F.col("attribute_name")))


def ordered_by_value(entity: DataFrame, attribute: DataFrame, name: str, descending: bool = False) -> DataFrame:
    """Entities with ``place`` by the attribute's smallest default value; those without come last either way."""
    key = attribute.where(live() & (F.col("attribute_name") == name) & F.col("dataset_id").isNull()).groupBy("entity_id").agg(F.min(F.struct("num", "str")).alias("__k"))
    k = F.col("__k")
    order = [k["num"].desc_nulls_last(), k["str"].desc_nulls_last()] if descending else [k["num"].asc_nulls_last(), k["str"].asc_nulls_last()]
    return entity.join(key, "entity_id", "left").orderBy(k.isNull(), *order, "entity_id")


def page(rows: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """A page of ordered rows; a limit of -1 is all. Take it of narrow rows and join the wide ones after."""
    out = rows.offset(offset) if offset else rows
    return out if limit < 0 else out.limit(limit)


def links(total: int, limit: int, offset: int) -> dict[str, int]:
    """Offsets of the previous and next page, where there are such."""
    out = {}
    if offset > 0:
        out["prev"] = max(0, offset - limit)
    if offset + limit < total:
        out["next"] = offset + limit
    return out


def linked(edges: DataFrame, roots: DataFrame, levels: int) -> DataFrame:
    """``(root, level, via, entity_id)``: what is reached from each root along relationships, up to ``levels`` steps.

    One equi-join for each level. ``linked_once`` visits each node of a root once. Levels are few and fixed in the plan.
    """
    at = roots.select(F.col("entity_id").alias("root"), F.col("entity_id").alias("here"))
    out = None
    for level in range(1, levels + 1):
        step = at.join(edges, F.col("here") == F.col("src")).select("root", F.lit(level).alias("level"), F.col("attribute_name").alias("via"), F.col("dst").alias("entity_id"))
        out = step if out is None else out.unionByName(step)
        at = step.select("root", F.col("entity_id").alias("here")).distinct()
    return out


def nested(parent: DataFrame, edges: DataFrame, child: DataFrame, name: str) -> DataFrame:
    """Parents with their targets inline: null for none, else the targets' ids in order."""
    targets = edges.where(F.col("attribute_name") == name).join(child.select(F.col("entity_id").alias("dst")), "dst").groupBy("src").agg(F.sort_array(F.collect_set("dst")).alias("entity"))
    return parent.join(targets, F.col("entity_id") == F.col("src"), "left").drop("src")


def in_list_order(wanted: DataFrame, entity: DataFrame) -> DataFrame:
    """Entities of a list ``(entity_id, pos)``, in its order."""
    return entity.join(wanted, "entity_id").orderBy("pos")


def concise(document: DataFrame) -> DataFrame:
    """Instances without what goes without saying: a lone plain value is the value, others keep their members."""

    def shorten(_: Column, instances: Column) -> Column:
        first = F.get(instances, F.lit(0))
        return (
            F.when(first["attribute_type"] == "LanguageProperty", F.to_json(F.create_map(F.lit("languageMap"), _languages(instances))))
            .when(F.size(instances) > 1, F.to_json(F.transform(instances, lambda i: F.struct(i["dataset_id"].alias("datasetId"), _plain(i).alias("value")))))
            .otherwise(_plain(first))
        )

    return document.withColumn("document", F.transform_values("document", shorten))


def linked_once(edges: DataFrame, roots: DataFrame, levels: int, pick: dict[int, list[str]] | None = None) -> DataFrame:
    """``(root, level, via, entity_id)``: as ``linked``, but no node twice for a root, and along picked relationships only.

    ``pick`` names the relationships that may be followed at a level; a level without an entry follows all. Each level's nodes
    are those that no level before it had.
    """
    at = roots.select(F.col("entity_id").alias("root"), F.col("entity_id").alias("here"))
    seen, out = at, None
    for level in range(1, levels + 1):
        along = edges.where(F.col("attribute_name").isin(pick[level])) if pick and level in pick else edges
        step = at.join(along, F.col("here") == F.col("src")).groupBy("root", F.col("dst").alias("here")).agg(F.min("attribute_name").alias("via"))
        step = step.join(seen, ["root", "here"], "left_anti")
        named = step.select("root", F.lit(level).alias("level"), "via", F.col("here").alias("entity_id"))
        out = named if out is None else out.unionByName(named)
        at = step.select("root", "here")
        seen = seen.unionByName(at)
    return out


def presence(entity: DataFrame, attribute: DataFrame, names: Iterable[str]) -> DataFrame:
    """``(entity_id, found)``: whether an entity has a live value of one of the attributes; a request for none of them fails."""
    some = attribute.where(live() & F.col("attribute_name").isin(list(names))).select("entity_id").distinct().withColumn("found", F.lit(True))
    return entity.join(some, "entity_id", "left").select("entity_id", F.coalesce("found", F.lit(False)).alias("found"))


def scope_values(history: DataFrame) -> DataFrame:
    """Scopes over time in the simplified form: per entity ``[(scopes, time), ...]`` in order of time."""
    pairs = F.sort_array(F.collect_list(F.struct("time", "value")))
    return history.groupBy("entity_id").agg(F.transform(pairs, lambda p: F.struct(p["value"], p["time"])).alias("values"))


def as_arrays(series: DataFrame, column: str) -> DataFrame:
    """A normalized temporal attribute is an array even of one instance."""
    kind = series.schema[column].dataType.typeName()
    return series if kind == "array" else series.withColumn(column, F.array(column))


def notification(attribute: DataFrame, names: Iterable[str], datasets: Iterable[str], terms: dict[str, str]) -> DataFrame:
    """What a notification shows of entities: picked attributes, a dataset view, short names, key-values."""
    rows = renamed(dataset_view(pick(attribute, names), datasets), terms, back=True)
    return simplified(documents(rows))


def wkt_point(lon: Column, lat: Column) -> Column:
    return F.concat(F.lit("POINT ("), lon.cast("string"), F.lit(" "), lat.cast("string"), F.lit(")"))


def point_of_wkt(text: Column) -> Column:
    """A struct (lon, lat) of a point's text, heights left out; null for anything else."""
    number = r"(-?[0-9.]+(?:[eE][-+]?[0-9]+)?)"
    pattern = rf"^\s*POINT\s*Z?\s*\(\s*{number}\s+{number}(?:\s+{number})?\s*\)\s*$"
    return F.when(text.rlike(pattern), F.struct(F.regexp_extract(text, pattern, 1).cast("double").alias("lon"), F.regexp_extract(text, pattern, 2).cast("double").alias("lat")))
