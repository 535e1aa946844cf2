"""Pages of coded event records: JSON of no fixed shape, read as VARIANT, with what is rejected kept beside what is read.

`pages` has value (the page's text) and may have other columns, which go along. A page that cannot be read gives one row
with a `reason` and no position; a record that cannot be used gives one with its position. A null or empty page is not
JSON; a page without records gives no row; repeated records stay, as separate positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentinelle.functions import scores

#: Variants that a field's text may come from; objects, lists and booleans are no text.
_SCALAR = "^(STRING|BIGINT|DOUBLE|FLOAT|DECIMAL)"
OBJECT, LIST = "map<string,variant>", "array<variant>"


def said(record: Column, key: str) -> Column:
    """A text or number as trimmed text; null where it is blank or of another kind."""
    text = F.trim(F.try_variant_get(record, f"$.{key}", "string"))
    return F.when((text != "") & F.schema_of_variant(F.try_variant_get(record, f"$.{key}", "variant")).rlike(_SCALAR), text)


def number(record: Column, key: str) -> Column:
    """A number, or a text that says one; null elsewhere."""
    return F.try_variant_get(record, f"$.{key}", "double")


def unpacked(pages: DataFrame, field: str, refused: bool = False) -> DataFrame:
    """One row a record of the list `field`: page_json (variant), returned (records of the page), position, record, reason.

    With `refused`, a page that says `"success": false` is rejected whatever else it holds.
    """
    page = F.try_parse_json("value")
    reason = F.coalesce(
        F.when(F.col("page_json").isNull(), "not json"),
        F.when(F.try_variant_get("page_json", "$", OBJECT).isNull(), "not an object"),
        F.when(F.lit(refused) & (F.schema_of_variant(F.try_variant_get("page_json", "$.success", "variant")) == "BOOLEAN") & ~F.try_variant_get("page_json", "$.success", "boolean"), "refused"),
        F.when(F.col("records").isNull(), f"no {field}"),
    )
    read = pages.withColumn("page_json", page).withColumn("records", F.try_variant_get("page_json", f"$.{field}", LIST)).withColumn("reason", reason)
    rest = [c for c in read.columns if c not in ("value", "records", "reason")]
    size = F.size("records").alias("returned")
    rows = read.select(*rest, size, "reason", F.posexplode_outer(F.when(F.col("reason").isNull(), F.col("records"))).alias("position", "record"))
    rows = rows.where("position is not null or reason is not null")
    stray = F.col("position").isNotNull() & F.try_variant_get("record", "$", OBJECT).isNull()
    return rows.withColumn("reason", F.coalesce("reason", F.when(stray, "not an object")))


def _place(record: Column) -> tuple[Column, Column]:
    """Latitude and longitude, both or none: half a pair or one off the globe is no place."""
    lat, lon = number(record, "latitude"), number(record, "longitude")
    whole = lat.between(-90, 90) & lon.between(-180, 180)
    return F.when(whole, lat), F.when(whole, lon)


def _deaths(record: Column, key: str) -> Column:
    n = number(record, key)
    return F.least(F.greatest(F.when(F.isnan(n), 0).otherwise(F.coalesce(n, F.lit(0))), F.lit(0)), F.lit(2_147_483_647)).cast("int")


def _day(text: Column) -> Column:
    return F.try_to_timestamp(F.substring(text, 1, 10), F.lit("yyyy-MM-dd"))


def _judged(out: DataFrame, given: list[str], unusable: Column) -> DataFrame:
    """The reason of every row, and no fields where the page could not be read. The pages' own variants go, if they are
    no columns of the caller."""
    reason = F.coalesce("reason", unusable)
    fields = [F.when(F.col("position").isNotNull(), F.col(c)).alias(c) for c in out.columns if c not in given]
    return out.select(*[c for c in given if c not in ("page_json", "record", "reason")], *fields, reason.alias("reason"))


def coded_type(text: Column) -> Column:
    low = F.lower(text)
    return (
        F.when(low.rlike("protest|riot"), "Protest")
        .when(low.rlike("explosion|remote violence|battle"), "Conflict")
        .when(low.contains("civilian"), "Terrorism")
        .when(low.contains("strategic development"), "MilitaryMovement")
        .otherwise("Other")
    )


def coded_rows(pages: DataFrame, limit: int = 5000) -> DataFrame:
    """Records of the first provider, used and rejected ones. A page is truncated if it has `limit` records, whether or
    not they can be used."""
    e = F.col("record")
    kind, sub, where, notes = (F.coalesce(said(e, k), F.lit("")) for k in ("event_type", "sub_event_type", "location", "notes"))
    headline = F.concat_ws(" in ", *[F.when(c != "", c) for c in (F.coalesce(F.when(sub != "", sub), kind), where)])
    deaths = _deaths(e, "fatalities")
    signal = (
        F.when(F.lower(sub).rlike("regains territory|overtakes territory|transfer of territory"), "TerritoryTransferred")
        .when(F.lower(sub).contains("headquarters or base established"), "PresenceEstablished")
        .otherwise("None")
    )
    actor, precision = said(e, "actor1"), number(e, "geo_precision")
    lat, lon = _place(e)
    rows = unpacked(pages, "data", refused=True)
    out = rows.withColumns(
        {
            "identifier": F.coalesce(said(e, "event_id_cnty"), said(e, "data_id")),
            "title": headline,
            "content": F.when(notes != "", notes).otherwise(headline),
            "event_type": coded_type(F.concat_ws(" ", kind, sub)),
            "severity": F.when((deaths == 0) & F.lower(kind).contains("battle"), "Medium").otherwise(scores.severity_from_deaths(deaths)),
            "lat": lat,
            "lon": lon,
            "precision": F.when(precision == 1, "Settlement").when(precision.isin(2.0, 3.0), "Region"),
            "country": said(e, "country"),
            "place": F.coalesce(F.when(where != "", where), said(e, "country")),
            "occurred": _day(said(e, "event_date")),
            "deaths": deaths,
            "control_signal": F.when(actor.isNotNull(), signal).otherwise("None"),
            "actor": actor,
            "truncated": F.col("returned") >= limit,
        }
    )
    unusable = F.when(F.col("identifier").isNull(), "no identifier").when(F.col("content") == "", "nothing said")
    return _judged(out, rows.columns, unusable)


def ged_rows(pages: DataFrame) -> DataFrame:
    """Records of the second provider, used and rejected ones; `more`: the page says that another one follows."""
    e = F.col("record")
    deaths, violence, precision = _deaths(e, "best"), number(e, "type_of_violence"), number(e, "where_prec")
    place = F.coalesce(*[said(e, k) for k in ("where_coordinates", "adm_2", "adm_1", "country")])
    lat, lon = _place(e)
    rows = unpacked(pages, "Result")
    out = rows.withColumns(
        {
            "identifier": F.coalesce(said(e, "id"), said(e, "relid")),
            "event_type": F.when(violence == 3, "Terrorism").otherwise("Conflict"),
            "severity": scores.severity_from_deaths(deaths),
            "place": place,
            "country": said(e, "country"),
            "precision": F.when(precision == 1, "Exact").when(precision == 2, "Settlement").when(precision.isin(3.0, 4.0, 5.0, 7.0), "Region").when(precision == 6, "Country"),
            "lat": lat,
            "lon": lon,
            "conflict_key": F.coalesce(said(e, "conflict_new_id"), said(e, "conflict_id")),
            "occurred": _day(F.coalesce(said(e, "date_start"), said(e, "date_end"))),
            "deaths": deaths,
            "more": F.coalesce((said(F.col("page_json"), "NextPageUrl").isNotNull()) | (number(F.col("page_json"), "TotalPages") > 1), F.lit(False)),
        }
    )
    silent = F.coalesce(said(e, "source_headline"), place, said(e, "conflict_name")).isNull()
    unusable = F.when(F.col("identifier").isNull(), "no identifier").when(silent, "nothing said")
    return _judged(out, rows.columns, unusable)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")


def coded_events(spark: SparkSession, path: str, limit: int = 5000) -> DataFrame:
    """Usable records of the first provider's JSON pages; `coded_rows` also has what was rejected."""
    return coded_rows(_files(spark, path), limit).where("reason is null").drop("reason")


def ged_events(spark: SparkSession, path: str) -> DataFrame:
    """Usable records of the second provider's JSON pages; `ged_rows` also has what was rejected."""
    return ged_rows(_files(spark, path)).where("reason is null").drop("reason")
