"""Two quality gates: do a backend's vectors carry meaning, and does approximate search retrieve."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.functions.vector import as_double, malformed, norm
from shelfmark.operators.embed import EmbeddingBackend
from shelfmark.operators.knn import count_close, exact_topk
from shelfmark.operators.probes import PROBE_GROUPS
from shelfmark.operators.sampling import uniform_sample

NEIGHBOUR_FLOOR, SEPARATION_FLOOR, HEALTHY_SEPARATION = 0.80, 0.05, 0.20
RECALL_FLOOR, DUPLICATE = 0.40, 0.9999
SEMANTIC_SCHEMA = "backend string, dims int, texts bigint, groups bigint, neighbour_rate double, intra double, inter double, separation double, duplicates bigint, failures array<string>, ok boolean"
RECALL_SCHEMA = "total bigint, with_vector bigint, probes int, k int, mean_recall double, self_hit double, failures array<string>, ok boolean"


def semantic_measures(vectors: DataFrame, id_col: str, group_col: str, field: str = "embedding") -> DataFrame:
    """One row: neighbour_rate, intra, inter, duplicates of vectors with a group.

    Means over pairs follow from the sums of unit vectors, so they cost one
    aggregation. The nearest neighbour, ties to the smaller id, and pairs that
    are all but equal come from the exact top two of each vector.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(group_col).cast("string").alias("g"), as_double(F.col(field)).alias("v"))
    unit = rows.select("id", "g", F.transform("v", lambda x: x).alias("v"), norm(F.col("v")).alias("size"))
    entries = unit.select("g", F.posexplode("v").alias("i", "x"), "size").select("g", "i", (F.col("x") / F.col("size")).alias("x"))
    sums = entries.groupBy("g", "i").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    inner = sums.groupBy("i").agg(F.sum(F.col("s") * F.col("s")).alias("ss"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    dots = inner.agg(F.sum(F.col("ss") - F.col("q")).alias("intra"), F.sum(F.col("s") * F.col("s") - F.col("ss")).alias("inter"))
    sizes = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n")).agg(F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum("n").alias("n"))
    means = dots.crossJoin(sizes).select(F.try_divide("intra", F.col("nn") - F.col("n")).alias("intra"), F.try_divide("inter", F.col("n") * F.col("n") - F.col("nn")).alias("inter"))  # a row each
    near = exact_topk(rows, rows.select(F.col("id").alias("qid"), F.col("v").alias("qv")), 2, "id", "v").filter("qid <> id")
    first = near.groupBy("qid").agg(F.min_by("id", F.struct("place", "id")).alias("id"))
    groups = rows.select("id", "g")
    hits = first.join(groups.select(F.col("id").alias("qid"), F.col("g").alias("qg")), "qid").join(groups, "id").agg(F.avg((F.col("g") == F.col("qg")).cast("int")).alias("neighbour_rate"))
    return means.crossJoin(hits).crossJoin(duplicate_pairs(rows))  # a row each


def duplicate_pairs(rows: DataFrame) -> DataFrame:
    """One row: pairs of (id, v) with a cosine above DUPLICATE.

    Equal directions are grouped first, so large groups of copies are counted,
    not paired; pairs of the distinct ones are counted block by block.
    """
    unit = rows.select("id", F.transform("v", lambda x: x).alias("v"), norm(F.col("v")).alias("size"))
    key = unit.select("id", F.transform("v", lambda x: F.round(x / F.col("size"), 9) + 0.0).alias("key"))
    same = key.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))
    alike = same.agg(F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).alias("alike"))
    firsts = same.select("id", F.col("key").alias("v"), "n")
    close = count_close(firsts, DUPLICATE)
    return alike.crossJoin(close).select((F.col("alike") + F.col("close")).alias("duplicates"))  # a row each


def check_backend(
    spark: SparkSession, backend: EmbeddingBackend, prefix: str = "", expect_dims: int | None = None, groups: dict | None = None,
    neighbour_floor: float = NEIGHBOUR_FLOOR, separation_floor: float = SEPARATION_FLOOR,
) -> DataFrame:
    """The semantic gate: one row of measures and failures; never raises for what a backend does."""
    probes = [(g, t) for g, titles in (groups or PROBE_GROUPS).items() for t in titles]
    base = {"backend": backend.name, "dims": 0, "texts": len(probes), "groups": len(groups or PROBE_GROUPS)}

    def report(failures: list[str], **more) -> DataFrame:
        row = base | {"neighbour_rate": None, "intra": None, "inter": None, "separation": None, "duplicates": 0} | more | {"failures": failures, "ok": not failures}
        return spark.createDataFrame([tuple(row[f.name] for f in T._parse_datatype_string(SEMANTIC_SCHEMA))], SEMANTIC_SCHEMA)

    try:
        found = backend.embed([prefix + t for _, t in probes])
    except Exception as e:  # whatever a backend raises is a finding
        return report([f"the backend did not answer: {e}; wait until it says Ready"])
    if len(found) != len(probes):
        return report([f"{len(found)} vectors came back, asked for {len(probes)}"])
    lengths = {len(v) for v in found}
    base["dims"] = next(iter(lengths)) if len(lengths) == 1 else 0
    if len(lengths) != 1 or not base["dims"]:
        return report([f"vectors are ragged or empty: lengths {sorted(lengths)}"])
    if expect_dims is not None and base["dims"] != expect_dims:
        return report([f"vectors have {base['dims']} entries, the index expects {expect_dims}"])
    rows = spark.createDataFrame([(i, g, [float(x) for x in v]) for i, ((g, _), v) in enumerate(zip(probes, found))], "id long, grp string, embedding array<double>")
    bad = rows.agg(F.count_if(malformed(F.col("embedding"))).alias("odd"), F.count_if(norm(F.col("embedding")) == 0).alias("zero")).first()
    if bad["odd"] or bad["zero"]:
        return report([f"{bad['odd']} vectors with entries that aren't finite, {bad['zero']} zero-length ones"])
    return judged(semantic_measures(rows, "id", "grp"), base, neighbour_floor, separation_floor)


def judged(measures: DataFrame, base: dict, neighbour_floor: float = NEIGHBOUR_FLOOR, separation_floor: float = SEPARATION_FLOOR) -> DataFrame:
    """The report of measures; failures add up. A separation that can't be measured doesn't fail."""
    apart = F.col("intra") - F.col("inter")
    failures = F.array_compact(
        F.array(
            F.when(F.col("duplicates") > 0, F.concat(F.col("duplicates").cast("string"), F.lit(" pairs of different texts have the same vector"))),
            F.when(F.col("neighbour_rate") < neighbour_floor, F.concat(F.lit("nearest neighbour in the same group: "), F.round("neighbour_rate", 2).cast("string"), F.lit(f", floor {neighbour_floor}"))),
            F.when(apart < separation_floor, F.concat(F.lit("separation of groups: "), F.round(apart, 4).cast("string"), F.lit(f", floor {separation_floor}"))),
        )
    )
    held = measures.withColumns({"separation": apart, "failures": failures} | {k: F.lit(v) for k, v in base.items()}).withColumn("ok", F.size("failures") == 0)
    schema = T._parse_datatype_string(SEMANTIC_SCHEMA)
    return held.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def coverage(df: DataFrame, field: str) -> DataFrame:
    """One row: total, with_vector, missing."""
    return df.agg(F.count(F.lit(1)).alias("total"), F.count(field).alias("with_vector")).withColumn("missing", F.col("total") - F.col("with_vector"))


def recall_by_probe(truth: DataFrame, found: DataFrame) -> DataFrame:
    """(qid, truth, hits, recall, self_hit) for each probe that has a truth; both sides (qid, id)."""
    base = truth.select("qid", "id").withColumn("t", F.lit(1)).join(found.select("qid", "id").withColumn("f", F.lit(1)), ["qid", "id"], "full")
    held = base.groupBy("qid").agg(F.count("t").alias("truth"), F.count_if(F.col("t").isNotNull() & F.col("f").isNotNull()).alias("hits"), F.max((F.col("f").isNotNull() & (F.col("qid") == F.col("id"))).cast("int")).alias("self_hit"))
    return held.filter("truth > 0").select("qid", "truth", "hits", (F.col("hits") / F.col("truth")).alias("recall"), "self_hit")


def check_recall(
    vectors: DataFrame, search: Callable[[DataFrame, int], DataFrame], id_col: str = "vec_id", field: str = "embedding", probes: int = 5, k: int = 10,
    floor: float = RECALL_FLOOR, seed: int = 0, supplied: DataFrame | None = None,
) -> DataFrame:
    """The recall gate: one row. ``search`` takes probes (qid, qv) and k and gives (qid, id).

    Stops without measuring when the table is empty, when vectors are missing or
    when there is no probe. All probes run in one job each way.
    """
    spark = vectors.sparkSession
    schema = T._parse_datatype_string(RECALL_SCHEMA)

    def report(**row) -> DataFrame:
        row = {"probes": 0, "k": k, "mean_recall": None, "self_hit": None} | row
        row["ok"] = not row["failures"]
        return spark.createDataFrame([tuple(row[f.name] for f in schema)], schema)

    n = coverage(vectors, field).first()
    seen = {"total": n["total"], "with_vector": n["with_vector"]}
    if not n["total"]:
        return report(**seen, failures=["the table is empty"])
    if n["missing"]:
        return report(**seen, failures=[f"{n['missing']} document(s) have no vector"])
    if supplied is None:
        supplied = uniform_sample(vectors.filter(F.col(field).isNotNull()), probes, id_col, seed).select(F.col(id_col).cast("long").alias("qid"), as_double(F.col(field)).alias("qv"))
    rows = supplied.orderBy("qid").limit(probes).collect()  # a few probes
    rows = [(r["qid"], list(r["qv"])) for r in rows if r["qv"]]
    if not rows:
        return report(**seen, failures=["no probe could be had"])
    chosen = spark.createDataFrame(rows, "qid long, qv array<double>")
    each = recall_by_probe(exact_topk(vectors, chosen, k, id_col, field), search(chosen, k))
    got = each.agg(F.count(F.lit(1)).alias("n"), F.avg("recall").alias("recall"), F.avg("self_hit").alias("self")).first()
    if not got["n"]:
        return report(**seen, failures=["no probe found anything"])
    low = [f"mean recall {got['recall']:.2f} is below {floor}"] if got["recall"] < floor else []
    return report(**seen, probes=got["n"], mean_recall=got["recall"], self_hit=got["self"], failures=low)
