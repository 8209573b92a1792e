"""Queries for sources, sinks, streams, interpretation and the whole flow."""

from __future__ import annotations

import json
import os

from pyspark.sql import functions as F

from tabulant.core.lineage import shared_folder
from tabulant.operators import causal, interpret, regression, search, series, stats
from tabulant.plans.analyze import analyze
from tabulant.plans.queries_search import COLUMNS, SUBJECT_SQL, TARGET, singles, subject
from tabulant.plans.queries_series import DAILY, KEYS, daily
from tabulant.plans.registry import query, rounded, table
from tabulant.sources import documents, files, paged, sql
from tabulant.streaming import chunks

# --- files ------------------------------------------------------------------------


@query("read_csv", "SELECT p_partkey, p_name, p_size::BIGINT AS p_size, p_retailprice FROM part")
def q_csv(spark, sf):
    folder = f"{shared_folder(spark)}/part.csv"
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_size", "p_retailprice")
    part.write.csv(folder, header=True)
    return rounded(files.read_csv(spark, folder))


@query(
    "read_csv_latin1",
    "SELECT c_custkey::BIGINT AS c_custkey, 'caf' || chr(233) || ' ' || c_mktsegment AS place FROM customer",
)
def q_latin1(spark, sf):
    folder = f"{shared_folder(spark)}/place.csv"
    df = table(spark, sf, "customer").select(
        "c_custkey", F.concat(F.lit("café "), "c_mktsegment").alias("place")
    )
    df.write.csv(folder, header=True, encoding="ISO-8859-1")
    return rounded(files.read_csv(spark, folder))


@query(
    "read_object",
    """SELECT s_suppkey, s_name, s_acctbal, fmt FROM supplier,
    (SELECT unnest(['json', 'parquet', 'csv']) AS fmt)""",
)
def q_object(spark, sf):
    base = shared_folder(spark)
    df = table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    out = None
    for fmt, writer in {"json": df.write.json, "parquet": df.write.parquet}.items():
        writer(f"{base}/supplier.{fmt}")
    df.write.csv(f"{base}/supplier", header=True)
    for fmt, path in {"json": "supplier.json", "parquet": "supplier.parquet", "csv": "supplier"}.items():
        part = files.read_object(spark, f"{base}/{path}", "text/csv" if fmt == "csv" else None)
        part = part.select("s_suppkey", "s_name", "s_acctbal", F.lit(fmt).alias("fmt"))
        out = part if out is None else out.unionByName(part)
    return rounded(out)


LISTED = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@query(
    "list_objects",
    " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS rows FROM {t}" for t in LISTED),
)
def q_list(spark, sf):
    """Rows of every listed object, counted by the file they come from."""
    listed = files.list_objects(spark, sf, "*.parquet").select("path")
    named = F.regexp_extract(F.col("path"), r"/(\w+)\.parquet(?:/[^/]*)?$", 1)
    listed = listed.select(F.url_decode("path").alias("path")).withColumn("name", named)
    rows = None
    for t in LISTED:
        part = table(spark, sf, t).groupBy(F.col("_metadata.file_path").alias("file")).count()
        rows = part if rows is None else rows.unionByName(part)
    bare = lambda c: F.regexp_replace(F.col(c), "^file:/+", "/")
    met = listed.join(rows, bare("path") == bare("file"))
    return rounded(met.groupBy("name").agg(F.sum("count").alias("rows")))


DESCRIBED = {
    "region": ["r_regionkey", "r_name"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
}


@query(
    "describe_tables",
    " UNION ALL ".join(
        f"SELECT 'described_{t}' AS \"table\", CAST({i} AS BIGINT) AS ordinal, '{c}' AS \"column\", "
        f"(SELECT count(*) FROM {t}) AS rows, (SELECT count(*) - count({c}) FROM {t}) AS nulls"
        for t, cs in DESCRIBED.items()
        for i, c in enumerate(cs)
    ),
)
def q_describe(spark, sf):
    """The described columns with the rows and nulls that each of them holds."""
    counts = None
    for name in DESCRIBED:
        df = table(spark, sf, name)
        df.createOrReplaceTempView(f"described_{name}")
        cells = F.array(
            *[
                F.struct(
                    F.lit(f"described_{name}").alias("table"),
                    F.lit(c).alias("column"),
                    F.col(c).isNull().cast("long").alias("empty"),
                )
                for c in df.columns
            ]
        )
        part = df.select(F.inline(cells)).groupBy("table", "column").agg(
            F.count(F.lit(1)).alias("rows"), F.sum("empty").alias("nulls")
        )
        counts = part if counts is None else counts.unionByName(part)
    described = sql.describe_tables(spark, pattern="described_*")
    return rounded(
        described.join(counts, ["table", "column"]).select(
            "table", "ordinal", "column", "rows", "nulls"
        )
    )


@query(
    "describe_documents",
    "SELECT count(*) AS documents, 'OBJECT<k: BIGINT>' AS fields FROM events",
)
def q_describe_documents(spark, sf):
    return rounded(sql.describe_documents(table(spark, sf, "events"), "props"))


def _nested(spark, sf):
    doc = F.struct(
        "event_id",
        F.struct(F.col("user_id").alias("id"), F.col("event_type").alias("action")).alias("user"),
        F.from_json("props", "k bigint").alias("props"),
        F.array("value").alias("values"),
    )
    return table(spark, sf, "events").select(F.to_json(doc).alias("value"))


@query(
    "read_documents",
    """SELECT event_id, user_id AS "user.id", event_type AS "user.action",
      CAST(props->>'k' AS BIGINT) AS "props.k", value AS first_value
    FROM events WHERE event_type = 'click'""",
)
def q_documents(spark, sf):
    folder = f"{shared_folder(spark)}/docs"
    _nested(spark, sf).write.text(folder)
    df = documents.read_documents(spark, folder, {"user.action": "click"})
    return df.select(
        "event_id", "`user.id`", "`user.action`", "`props.k`", F.col("values")[0].alias("first_value")
    )


@query(
    "normalize_responses",
    """SELECT event_id, CAST(props->>'k' AS BIGINT) AS k FROM events,
    (SELECT unnest([1, 2]) AS copy)
    WHERE copy = 1 OR event_id % 5 IN (0, 1, 3)""",
)
def q_responses(spark, sf):
    p = F.col("props")
    pair = F.concat(F.lit("["), p, F.lit(", "), p, F.lit("]"))
    shape = F.col("event_id") % 5
    body = (
        F.when(shape == 0, pair)
        .when(shape == 1, F.concat(F.lit('{"data": '), pair, F.lit("}")))
        .when(shape == 2, F.concat(F.lit('{"data": '), p, F.lit("}")))
        .when(shape == 3, F.concat(F.lit('{"results": '), pair, F.lit("}")))
        .otherwise(p)
    )
    raw = table(spark, sf, "events").select("event_id", body.alias("body"))
    return documents.normalize_responses(raw, "body", keep=("event_id",))


PAGE = 500


def _page_fetch(folder: str):
    """Pages of orders from files, as a service would give them."""
    folder = folder.removeprefix("file://").removeprefix("file:")

    def fetch(request: dict):
        p = request["params"]
        page = p["offset"] // p["limit"] if "offset" in p else p["page"] - 1
        place = os.path.join(folder, f"page={page}")
        if not os.path.isdir(place):
            return {"data": []}
        items = []
        for name in sorted(os.listdir(place)):
            if name.endswith(".json"):
                with open(os.path.join(place, name), encoding="utf-8") as f:
                    items += [json.loads(line) for line in f]
        return {"data": items}

    return fetch


@query("paged_source", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def q_pages(spark, sf):
    folder = f"{shared_folder(spark)}/pages"
    orders = table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", F.floor(F.col("o_orderkey") / PAGE).alias("page")
    )
    orders.repartition("page").write.partitionBy("page").json(folder)
    return paged.read_pages(
        spark,
        "order_pages",
        _page_fetch(folder),
        "o_orderkey long, o_custkey long, o_totalprice double",
        paging="page",
        page_size=PAGE,
        partitions=4,
    )


@query(
    "stream_chunks",
    "SELECT count(*) AS n, round(sum(o_totalprice) / 1e6, 4) AS total FROM orders",
)
def q_chunks(spark, sf):
    base = shared_folder(spark)
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    orders.repartition(4, "o_orderkey").write.parquet(f"{base}/in")
    stream = chunks.open_stream(spark, f"{base}/in", orders.schema, files_per_chunk=2)

    def keep(chunk, number):
        chunk.write.mode("overwrite").parquet(f"{base}/out/chunk={number}")

    chunks.stream_chunks(stream, keep, f"{base}/state")
    done = spark.read.parquet(f"{base}/out")
    return rounded(done.agg(F.count("*").alias("n"), (F.sum("o_totalprice") / 1e6).alias("total")))


@query(
    "streaming_profile",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, count(*) AS rows, count(*) - count({e}) AS nulls, min({e}) AS min,
        max({e}) AS max, round(avg({e}), 4) AS mean, round(stddev_samp({e}), 4) AS std FROM events"""
        for c, e in [("value", "value"), ("user", "nullif(user_id, 7)::DOUBLE")]
    ),
)
def q_stream_profile(spark, sf):
    folder = f"{shared_folder(spark)}/in"
    events = table(spark, sf, "events").select(
        "value", F.nullif(F.col("user_id"), F.lit(7)).alias("user")
    )
    events.repartition(4).write.parquet(folder)
    stream = chunks.open_stream(spark, folder, events.schema)
    return rounded(chunks.streaming_profile(stream).drop("sum", "sum_squares"))


@query(
    "write_results",
    "SELECT l_returnflag, count(*) AS n, round(avg(l_tax), 6) AS tax FROM lineitem GROUP BY 1",
)
def q_write(spark, sf):
    df = rounded(
        table(spark, sf, "lineitem")
        .groupBy("l_returnflag")
        .agg(F.count("*").alias("n"), F.avg("l_tax").alias("tax")),
        6,
    )
    folder = files.write_results({"flags": df}, shared_folder(spark))["flags"]
    return spark.read.json(folder)


# --- interpretation ----------------------------------------------------------------


def _bands(value, words, sign):
    cases = "".join(f" WHEN {value} {sign} {lim} THEN '{w}'" for lim, w in words)
    return cases


SCORES_SQL = f"""{SUBJECT_SQL}, s AS ("""+ " UNION ALL ".join(
    f"SELECT '{c}' AS f, abs(corr({c}, volume)) AS e, regr_r2(volume, {c}) AS c FROM x" for c in COLUMNS
) + ")"


def _scored(spark, sf):
    return search.score_subsets(subject(spark, sf), singles(spark), TARGET, COLUMNS)


@query(
    "label_hypotheses",
    f"""WITH {SCORES_SQL}
    SELECT f AS features, CASE WHEN e > 0.5 THEN 'strong' WHEN e > 0.3 THEN 'moderate' ELSE 'weak' END AS effect,
      CASE WHEN c > 0.7 THEN 'explains most of what''s happening'
           WHEN c > 0.5 THEN 'explains a good deal of what''s happening'
           WHEN c > 0.3 THEN 'explains some of what''s happening'
           ELSE 'explains only a little of what''s happening' END AS coverage_text FROM s""",
)
def q_label(spark, sf):
    out = interpret.label_hypotheses(_scored(spark, sf))
    return out.select(F.array_join("features", ",").alias("features"), "effect", "coverage_text")


@query("hypothesis_sentences")
def q_sentences(spark, sf):
    return interpret.label_hypotheses(_scored(spark, sf)).select("subset_id", "sentence")


@query(
    "label_effects",
    """WITH e AS (SELECT 'l_quantity' AS treatment, regr_slope(l_tax, l_quantity) AS b FROM lineitem
      UNION ALL SELECT 'l_discount', regr_slope(l_tax, l_discount) FROM lineitem)
    SELECT treatment, CASE WHEN abs(b) < 0.01 THEN 'no significant causal effect'
      WHEN abs(b) < 0.1 THEN 'a small causal effect' WHEN abs(b) < 0.3 THEN 'a moderate causal effect'
      ELSE 'a strong causal effect' END AS size,
      CASE WHEN b > 0 THEN 'increases' ELSE 'decreases' END AS direction FROM e""",
)
def q_effects(spark, sf):
    df = table(spark, sf, "lineitem")
    out = causal.causal_effect(df, "l_quantity", "l_tax").unionByName(
        causal.causal_effect(df, "l_discount", "l_tax")
    )
    return interpret.label_effects(out).select("treatment", "size", "direction")


@query(
    "label_tests",
    f"""WITH {SCORES_SQL}
    SELECT f AS features, CASE WHEN c > 0.5 THEN 'of practical importance' WHEN c > 0.2 THEN 'noticeable'
      ELSE 'of little practical use' END AS practical FROM s""",
)
def q_label_tests(spark, sf):
    scored = _scored(spark, sf).select(
        F.array_join("features", ",").alias("features"),
        (1 - F.col("significance")).alias("p_value"),
        F.col("coverage").alias("r_squared"),
        "effect_size",
    )
    return interpret.label_tests(scored).select("features", "practical")


@query("label_regressions")
def q_label_regressions(spark, sf):
    df = table(spark, sf, "lineitem")
    return interpret.label_regressions(
        regression.linear_regression(df, ["l_quantity", "l_tax"], "l_extendedprice")
    ).withColumn("significant", F.array_join("significant", ","))


@query(
    "label_trends",
    f"""WITH {DAILY}, t AS (SELECT event_type, regr_slope(v, pos) AS b, sqrt(regr_r2(v, pos)) AS r
      FROM p GROUP BY 1), w AS (SELECT *, CASE WHEN b > 0 THEN 'increasing' ELSE 'decreasing' END AS direction,
      CASE WHEN r > 0.5 THEN 'strong' WHEN r > 0.3 THEN 'moderate' ELSE 'weak' END AS word FROM t)
    SELECT event_type, event_type || ' shows a ' || word || ' ' || direction || ' trend over time.' AS sentence
    FROM w""",
)
def q_label_trends(spark, sf):
    trends = series.detect_trend(daily(spark, sf), *KEYS)
    return interpret.label_trends(trends, "event_type").select("event_type", "sentence")


@query(
    "summarize_hypotheses",
    f"""WITH {SCORES_SQL}
    SELECT count(*) AS hypotheses, round(avg(e), 6) AS mean_effect, round(avg(c), 6) AS mean_coverage,
      CASE WHEN avg(e) > 0.5 THEN 'strong' WHEN avg(e) > 0.3 THEN 'moderate' ELSE 'weak' END AS effect,
      CASE WHEN avg(c) > 0.5 THEN 'substantial portions' WHEN avg(c) > 0.3 THEN 'some'
        ELSE 'limited portions' END AS coverage_text FROM s""",
)
def q_summary(spark, sf):
    out = interpret.summarize_hypotheses(_scored(spark, sf))
    return rounded(
        out.select("hypotheses", "mean_effect", "mean_coverage", "effect", "coverage_text"), 6
    )


@query(
    "report_weights",
    """WITH h AS (SELECT l_suppkey AS id, 's' || (l_suppkey % 4) AS a, 't' || (l_suppkey % 3) AS b,
        round(avg(l_discount) * 10, 6) AS significance, round(avg(l_tax), 6) AS fitness FROM lineitem GROUP BY 1),
    r AS (SELECT *, row_number() OVER (ORDER BY fitness DESC, a || ',' || b) AS rank FROM h),
    e AS (SELECT a AS feature, significance FROM r WHERE rank <= 5
          UNION ALL SELECT b, significance FROM r WHERE rank <= 5)
    SELECT feature, round(sum(significance), 6) AS weight, count(*) AS hypotheses FROM e
    GROUP BY 1 ORDER BY weight DESC, feature LIMIT 8""",
)
def q_report(spark, sf):
    k = F.col("l_suppkey")
    hyps = table(spark, sf, "lineitem").groupBy(k.alias("subset_id")).agg(
        F.round(F.avg("l_discount") * 10, 6).alias("significance"),
        F.round(F.avg("l_tax"), 6).alias("fitness"),
    )
    hyps = hyps.withColumns(
        {
            "features": F.array(
                F.concat(F.lit("s"), (F.col("subset_id") % 4).cast("string")),
                F.concat(F.lit("t"), (F.col("subset_id") % 3).cast("string")),
            ),
            "effect_size": F.lit(0.4),
            "coverage": F.lit(0.4),
        }
    )
    return rounded(interpret.report_tables(hyps)["weights"], 6)


@query("report_detail")
def q_report_detail(spark, sf):
    scored = _scored(spark, sf)
    tests = stats.pearson_test(subject(spark, sf), COLUMNS, TARGET)
    tables = interpret.report_tables(scored, tests)
    top = tables["top"].select("rank", F.array_join("features", ",").alias("item"), F.col("fitness").alias("value"))
    tested = tables["tests"].select(F.lit(0).alias("rank"), F.col("feature").alias("item"), F.col("statistic").alias("value"))
    return top.unionByName(tested)


@query("analyze")
def q_analyze(spark, sf):
    orders = table(spark, sf, "orders")
    customer = table(spark, sf, "customer")
    df = orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        F.col("o_orderkey").alias("row_key"),
        "o_orderstatus",
        "o_orderpriority",
        "c_mktsegment",
        "c_acctbal",
        F.year("o_orderdate").cast("double").alias("year"),
        F.when(F.col("o_custkey") % 9 != 0, F.month("o_orderdate").cast("double")).alias("month"),
        "o_totalprice",
    )
    out = analyze(df, row_key="row_key", selection="mutual_info", selection_k=50, models=True)
    parts = None
    for name, t in sorted(out.items()):
        part = t.agg(F.lit(name).alias("stage"), F.count(F.lit(1)).alias("rows"))
        parts = part if parts is None else parts.unionByName(part)
    return parts
