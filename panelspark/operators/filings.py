"""Filings: calendar candidates from submissions, text validation, company facts, and facts as they were known at an event."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.numbers import number, ratio
from panelspark.functions.texts import single_spaced, stripped
from panelspark.operators.asof import asof_backward
from panelspark.operators.staging import materialise
from panelspark.sources.tables import keep_last

# Wordings of filings about earnings and about other matters.
EARNINGS = ("financial results", "earnings results", "quarterly results", "results for the quarter", "results for its quarter", "results for its fiscal", "fiscal quarter", "quarter ended", "quarter and year ended")
OTHER = ("production and deliveries", "vehicle production", "deliveries and production", "annual meeting", "election of directors", "departure of directors", "compensatory arrangements", "submission of matters", "definitive merger agreement", "notes due")
ITEM = "item 2.02"
# Statuses of a filing's text; the first three settle the matter.
VALIDATED, UNRELATED, NOT_ITEM, AMBIGUOUS, NO_TEXT = "validated_earnings_release", "non_earnings_item_2_02", "not_item_2_02_text", "ambiguous_item_2_02_text", "missing_text"
DECISIVE = (VALIDATED, UNRELATED, NOT_ITEM)
# Which concepts of company facts are which feature.
CONCEPTS = {
    "Assets": "assets", "Liabilities": "liabilities", "CashAndCashEquivalentsAtCarryingValue": "cash", "CashAndCashEquivalentsAndShortTermInvestments": "cash", "CurrentAssets": "current_assets", "AssetsCurrent": "current_assets",
    "CurrentLiabilities": "current_liabilities", "LiabilitiesCurrent": "current_liabilities", "Revenues": "revenue", "RevenueFromContractWithCustomerExcludingAssessedTax": "revenue", "SalesRevenueNet": "revenue", "NetIncomeLoss": "net_income", "OperatingIncomeLoss": "operating_income",
}
FEATURES = tuple(dict.fromkeys(CONCEPTS.values()))


def timing(accepted: Column) -> Column:
    """When in the trading day an instant lies: before 9:30 ET, from 16:00 on, between, or unknown."""
    local = F.from_utc_timestamp(accepted, "America/New_York")
    minutes = F.hour(local) * 60 + F.minute(local)
    return F.when(minutes < 570, "BMO").when(minutes >= 960, "AMC").when(minutes.isNotNull(), "DMH").otherwise("UNKNOWN")


def local_date(accepted: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(accepted, "America/New_York"))


def aware_timestamp(text: Column) -> Column:
    """The instant of a text with a zone (Z or an offset); without one it is null, as its instant is unknown."""
    zoned = stripped(text).rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})$")
    return F.when(zoned, F.try_to_timestamp(stripped(text)))


def validate_calendar(calendar: DataFrame, timing_col: str = "announcement_timing") -> DataFrame:
    """The calendar with its timing in capitals, one of four (else UNKNOWN), and whether it is before the open or after the close."""
    told = F.upper(stripped(timing_col))
    out = calendar.withColumn(timing_col, F.when(told.isin("BMO", "AMC", "DMH", "UNKNOWN"), told).otherwise("UNKNOWN"))
    return out.withColumn("is_main_sample_timing", F.col(timing_col).isin("BMO", "AMC"))


def text_status(text: Column) -> Column:
    """What a filing's text says: other matters beat earnings, and without the item number neither counts."""
    has = lambda flat, marks: F.greatest(*[F.contains(flat, F.lit(m)) for m in marks])
    said = lambda flat: F.when(~F.contains(flat, F.lit(ITEM)), NOT_ITEM).when(has(flat, OTHER), UNRELATED).when(has(flat, EARNINGS), VALIDATED).otherwise(AMBIGUOUS)
    # an array of one text, as Spark would make the text anew for each of twenty marks
    return F.when(F.coalesce(text, F.lit("")) == "", NO_TEXT).otherwise(F.get(F.transform(F.array(F.lower(single_spaced(text))), said), F.lit(0)))


def classify_filing(texts: DataFrame, text: str) -> DataFrame:
    return texts.withColumn("status", text_status(F.col(text)))


def validate_by_text(candidates: DataFrame, official: DataFrame, auxiliary: DataFrame | None = None) -> DataFrame:
    """Candidates with text_status and its source: the official text decides, else the auxiliary one where that settles the matter.

    Texts: ticker, source_id, text. auxiliary_status is empty where the auxiliary text wasn't asked.
    """
    key = ["ticker", "source_id"]
    one = lambda t, name: t.select(F.upper("ticker").alias("ticker"), "source_id", text_status(F.col("text")).alias(name)).dropDuplicates(key)
    out = candidates.withColumn("ticker", F.upper("ticker")).join(one(official, "_first"), key, "left").withColumn("_first", F.coalesce("_first", F.lit(NO_TEXT)))
    settled = F.col("_first").isin(*DECISIVE)
    if auxiliary is not None:
        out = out.join(one(auxiliary, "_second"), key, "left").withColumn("_second", F.coalesce("_second", F.lit(NO_TEXT)))
    else:
        out = out.withColumn("_second", F.lit(""))
    asked = ~settled & F.lit(auxiliary is not None)
    fallback = asked & F.col("_second").isin(*DECISIVE)
    out = out.withColumns({"text_validation_status": F.when(fallback, F.col("_second")).otherwise(F.col("_first")), "text_validation_source": F.when(fallback, "auxiliary_text_fallback").otherwise("official_text"), "text_validation_aux_status": F.when(asked, F.col("_second")).otherwise("")})
    out = out.withColumn("is_validated_earnings_event", F.col("text_validation_status") == VALIDATED).drop("_first", "_second")
    if "is_main_sample_timing" in candidates.columns:
        out = out.withColumn("is_main_sample_candidate", F.col("is_main_sample_timing") & F.col("is_validated_earnings_event"))
    return out


BLOCK = "struct<form: array<string>, items: array<string>, filingDate: array<string>, acceptanceDateTime: array<string>, accessionNumber: array<string>, reportDate: array<string>, primaryDocument: array<string>>"
SUBMISSIONS = f"struct<cik: bigint, filings: struct<recent: {BLOCK}>, archive_payloads: array<{BLOCK}>>"


def submission_candidates(payloads: DataFrame, start: str, end: str, json_col: str = "payload") -> DataFrame:
    """Earnings candidates from submission files (ticker, JSON text): 8-K filings with item 2.02 between two dates.

    Recent filings and archives hold parallel arrays. Of one accession the recent entry counts, then earlier archives.
    The announcement's date is the local date of acceptance, else of the filing.
    """
    parsed = payloads.select(F.upper("ticker").alias("ticker"), F.from_json(json_col, SUBMISSIONS).alias("j"))
    blocks = F.concat(F.array("j.filings.recent"), F.coalesce("j.archive_payloads", F.array().cast(f"array<{BLOCK}>")))
    each = parsed.select("ticker", F.col("j.cik").alias("cik"), F.posexplode(blocks).alias("block", "b"))
    names = ["form", "items", "filingDate", "acceptanceDateTime", "accessionNumber", "reportDate", "primaryDocument"]
    rows = each.where(F.col("b.form").isNotNull()).select("ticker", "cik", "block", F.posexplode(F.arrays_zip(*[F.coalesce(F.col(f"b.{n}"), F.array().cast("array<string>")).alias(n) for n in names])).alias("place", "f")).select("ticker", "cik", "block", "place", "f.*")
    rows = rows.where((stripped("form") == "8-K") & F.contains(F.coalesce("items", F.lit("")), F.lit("2.02")))
    accepted = aware_timestamp(F.col("acceptanceDateTime"))
    rows = rows.withColumns({"accepted_at": accepted, "filing_date": F.try_to_date(F.substring("filingDate", 1, 10))}).withColumns({"acceptance_local_date": local_date(F.col("accepted_at")), "acceptance_inferred_timing": timing(F.col("accepted_at"))})
    rows = rows.withColumn("announcement_date", F.coalesce("acceptance_local_date", "filing_date")).where(F.col("announcement_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    main = F.col("acceptance_inferred_timing").isin("BMO", "AMC")
    rows = rows.withColumns({
        "announcement_timing": F.when(main, F.col("acceptance_inferred_timing")).otherwise("UNKNOWN"), "is_main_sample_timing": main, "source": F.when(F.col("block") == 0, "sec_edgar_submissions_recent").otherwise("sec_edgar_submissions_archive"),
        "filing_acceptance_date_mismatch": F.coalesce(F.col("filing_date") != F.col("acceptance_local_date"), F.lit(False)), "announcement_date_source": F.when(F.col("acceptance_local_date").isNotNull(), "sec_acceptance_local_date_proxy").otherwise("sec_filing_date"),
    })
    one = keep_last(rows, ["ticker", "accessionNumber"], [F.col("block"), F.col("place")])
    return one.withColumnsRenamed({"accessionNumber": "source_id", "form": "form_type", "items": "sec_items"}).drop("block", "place", "filingDate", "acceptanceDateTime")


def acceptance_times(payloads: DataFrame, json_col: str = "payload") -> DataFrame:
    """ticker, accn, acceptance_datetime of every filing in submission files; of one accession the last block counts."""
    parsed = payloads.select(F.upper("ticker").alias("ticker"), F.from_json(json_col, SUBMISSIONS).alias("j"))
    blocks = F.concat(F.array("j.filings.recent"), F.coalesce("j.archive_payloads", F.array().cast(f"array<{BLOCK}>")))
    each = parsed.select("ticker", F.posexplode(blocks).alias("block", "b"))
    zipped = F.arrays_zip(F.col("b.accessionNumber").alias("accn"), F.col("b.acceptanceDateTime").alias("at"))
    rows = each.where("b.accessionNumber IS NOT NULL AND b.acceptanceDateTime IS NOT NULL").select("ticker", "block", F.posexplode(zipped).alias("place", "f")).where("f.accn <> '' AND f.at <> ''")
    return keep_last(rows.select("ticker", "block", "place", "f.accn", "f.at"), ["ticker", "accn"], [F.desc("block"), F.desc("place")]).select("ticker", "accn", aware_timestamp(F.col("at")).alias("acceptance_datetime"))


ENTRY = "struct<val: double, start: string, end: string, fy: bigint, fp: string, form: string, filed: string, frame: string, accn: string>"
FACTS = f"struct<facts: struct<`us-gaap`: map<string, struct<units: map<string, array<{ENTRY}>>>>>>"


def company_facts(payloads: DataFrame, accepted: DataFrame | None = None, json_col: str = "payload") -> DataFrame:
    """Long facts (ticker, concept, feature_concept, val, end, filed, accn, acceptance_datetime) of fact files: known concepts in USD only.

    ``accepted``: ticker, accn, acceptance_datetime.
    """
    parsed = payloads.select(F.upper("ticker").alias("ticker"), F.from_json(json_col, FACTS).alias("j"))
    known = F.create_map(*[F.lit(x) for pair in CONCEPTS.items() for x in pair])
    of = parsed.select("ticker", F.explode(F.col("j.facts.`us-gaap`")).alias("sec_concept", "c"))
    of = of.where(F.col("sec_concept").isin(*CONCEPTS)).select("ticker", "sec_concept", F.explode("c.units").alias("unit", "entries")).where(F.upper("unit") == "USD")
    rows = of.select("ticker", "sec_concept", "unit", F.inline("entries")).withColumns({"feature_concept": known[F.col("sec_concept")], "filed": F.try_to_date("filed"), "end": F.try_to_date("end"), "start": F.try_to_date("start"), "accn": F.coalesce("accn", F.lit(""))})
    if accepted is None:
        return rows.withColumn("acceptance_datetime", F.lit(None).cast("timestamp"))
    return rows.join(accepted.select("ticker", "accn", "acceptance_datetime"), ["ticker", "accn"], "left")


def company_metadata(payloads: DataFrame, json_col: str = "payload") -> DataFrame:
    """ticker, cik, sic, sic_description, entity_type, category of submission files."""
    get = lambda name: F.get_json_object(json_col, f"$.{name}")
    return payloads.select(F.upper("ticker").alias("ticker"), get("cik").try_cast("bigint").alias("cik"), get("sic").alias("sic"), get("sicDescription").alias("sic_description"), get("entityType").alias("entity_type"), get("category").alias("category"))


def texts_by_accession(payloads: DataFrame, json_col: str = "payload") -> DataFrame:
    """ticker, source_id, text of filing-text files; of one accession the last entry counts."""
    entry = "struct<results: array<struct<accession_number: string, items_text: string>>>"
    rows = payloads.select(F.upper("ticker").alias("ticker"), F.posexplode(F.from_json(json_col, entry)["results"]).alias("place", "r")).where("r.accession_number <> ''")
    one = keep_last(rows.select("ticker", F.col("r.accession_number").alias("source_id"), F.coalesce("r.items_text", F.lit("")).alias("text"), "place"), ["ticker", "source_id"], [F.desc("place")])
    return one.drop("place")


def facts_at_events(events: DataFrame, facts: DataFrame, event: str = "event_id", asof: str = "asof", concepts: Sequence[str] = FEATURES) -> DataFrame:
    """``events`` with ratios and growth of the facts that were known at ``asof``, how fresh they are and how many counted.

    A fact counts from its acceptance on, or, without one, from the day after its filing; one filed on the day of the event
    without acceptance is dropped and counted. Growth compares the last two values of a concept. All that is known of a
    ticker is one narrow row for each instant at which it changes, and events meet these rows in one as-of join.
    """
    c = F.col
    named = facts.select(F.upper("ticker").alias("_ticker"), c("feature_concept").alias("concept"), number("val").alias("val"), "end", c("filed").cast("date").alias("filed"), c("acceptance_datetime").alias("accepted"))
    known = F.coalesce("accepted", F.date_add("filed", 1).cast("timestamp"))
    # all that follows lies inside a ticker, so facts are shuffled once
    rows = named.withColumns({"_at": known, "_sort": F.coalesce("accepted", c("filed").cast("timestamp")), "_mapped": c("accepted").isNotNull()}).where("_at IS NOT NULL").repartition("_ticker")
    item = F.struct("_sort", "end", c("val").alias("_value"))
    own = Window.partitionBy("_ticker", "concept", "_mapped", c("val").isNull())
    rows = rows.withColumns({"_item": F.when(c("val").isNotNull(), F.struct(item.alias("now"), F.lag(item).over(own.orderBy("_sort", "end", "val")).alias("last"))), "_n": F.row_number().over(Window.partitionBy("_ticker", "concept").orderBy("_at"))})
    # a fact filed without acceptance tells of its day, too
    fact = F.struct("_at", F.lit(True).alias("_fact"), F.lit(None).cast("date").alias("_day"))
    told = F.when(c("_mapped"), F.array(fact)).otherwise(F.array(fact, F.struct(c("filed").cast("timestamp").alias("_at"), F.lit(False).alias("_fact"), c("filed").alias("_day"))))
    each = rows.select("_ticker", "concept", "_mapped", "_sort", "_item", "_n", F.inline(told))
    of = {(x, m): F.max(F.when(c("_fact") & (c("concept") == x) & (c("_mapped") == m), c("_item"))) for x in concepts for m in (True, False)}
    names = {k: f"_i{i}" for i, k in enumerate(of)}
    count = lambda test: F.count_if(c("_fact") & test)
    cells = each.groupBy("_ticker", "_at").agg(
        *[v.alias(names[k]) for k, v in of.items()], count(c("_mapped")).alias("m"), count(~c("_mapped")).alias("f"), count(c("concept").isNotNull() & (c("_n") == 1)).alias("k"), F.max(F.when(c("_fact"), c("_sort"))).alias("_sort"), F.max("_day").alias("_day"), F.count_if(~c("_fact")).alias("_same")
    )
    upto = Window.partitionBy("_ticker").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    best = lambda x: F.reverse(F.array_sort(F.array_compact(F.array(*[c(names[x, m])[w] for m in (True, False) for w in ("now", "last")]))))
    states = cells.select("_ticker", "_at", *[F.max(n).over(upto).alias(n) for n in names.values()], *[F.sum(a).over(upto).alias(n) for a, n in (("m", "mapped_acceptance_rows"), ("f", "fallback_filed_rows"), ("k", "coverage"))], F.last("_sort", True).over(upto).alias("_sort"), F.max(F.when(c("_day").isNotNull(), F.struct("_day", "_same"))).over(upto).alias("_d"))
    counts = ("mapped_acceptance_rows", "fallback_filed_rows", "coverage")
    states = states.withColumns({f"_b{i}": best(x) for i, x in enumerate(concepts)})
    states = states.select("_ticker", "_at", *counts, "_sort", "_d._day", "_d._same", *[F.get(f"_b{i}", F.lit(0))["_value"].alias(x) for i, x in enumerate(concepts)], *[F.get(f"_b{concepts.index(x)}", F.lit(1))["_value"].alias(f"_{x}") for x in ("revenue", "net_income")])
    values = [n for n in states.columns if n not in ("_ticker", "_at")]
    out = asof_backward(events.withColumn("_ticker", F.upper("ticker")), materialise(states, "fact-states"), ["_ticker"], asof, "_at", values).drop("_ticker", "matched__at")
    same = F.when(c("_day") == F.to_date(asof), c("_same"))
    out = out.withColumns({n: F.coalesce(n, F.lit(0)) for n in counts} | {"dropped_same_day_rows": F.coalesce(same, F.lit(0))}).drop("_day", "_same")
    out = out.withColumns({
        "available": (c("mapped_acceptance_rows") + c("fallback_filed_rows")) > 0, "log_assets": F.log1p(F.greatest("assets", F.lit(0.0))), "log_revenue": F.log1p(F.greatest("revenue", F.lit(0.0))), "cash_to_assets": ratio(c("cash"), c("assets")),
        "liabilities_to_assets": ratio(c("liabilities"), c("assets")), "current_ratio": ratio(c("current_assets"), c("current_liabilities")), "roa": ratio(c("net_income"), c("assets")), "operating_margin": ratio(c("operating_income"), c("revenue")),
        "revenue_growth": ratio(c("revenue"), c("_revenue")) - 1, "net_income_growth": ratio(c("net_income"), c("_net_income")) - 1, "freshness_days": (F.unix_micros(asof) - F.unix_micros("_sort")) / 86400e6,
    })
    # the logarithm of a missing number is missing
    out = out.withColumns({"log_assets": F.when(c("assets").isNotNull(), c("log_assets")), "log_revenue": F.when(c("revenue").isNotNull(), c("log_revenue"))})
    return out.drop("_revenue", "_net_income", "_sort")
