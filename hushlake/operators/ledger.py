"""A lasting ledger of privacy budgets: every private answer is paid for in a table that all jobs share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.prf import uniform
from ..sources.keys import key, with_keys
from ..sources.staging import dropped, stored
from .privacy import budget_fold

ENTRIES = "tenant_id string, request_id string, kind string, epsilon double, total double, accepted boolean, reason string, consumed double, remaining double, warning boolean, answer double, selected string, batch int"
KINDS = ["count", "sum", "average", "select"]
#: What a request may lack, and its value then: sensitivity (of an average the range of its values), delta, and the rows of an average.
DEFAULTS = {"sensitivity": 1.0, "delta": 1e-5, "true_value": None, "true_count": None}


class Ledger:
    """Entries (one a request) under a folder: budgets outlive a job, and a repeated request gets its first answer.

    Each call of ``release`` writes one batch, a folder of its own that counts from when it is complete; payments and answers are the same rows, so
    no number leaves without its payment. One job writes at a time: a second one meets the first one's batch folder and fails.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def batches(self) -> list[int]:
        """Numbers of the complete batches."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        files = path.getFileSystem(conf)
        if not files.exists(path):
            return []
        found = [s.getPath() for s in files.listStatus(path) if s.isDirectory() and s.getPath().getName().startswith("batch=")]
        return sorted(int(p.getName()[6:]) for p in found if files.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def entries(self) -> DataFrame:
        numbers = self.batches()
        if not numbers:
            return self.spark.createDataFrame([], ENTRIES)
        return self.spark.read.schema(ENTRIES).option("basePath", self.folder).parquet(*[f"{self.folder}/batch={n}" for n in numbers])

    def accounts(self) -> DataFrame:
        """(tenant_id, requests, accepted, consumed, remaining) of every tenant that has asked; remaining by the latest total."""
        total = F.max_by("total", "batch")
        consumed = F.max("consumed")
        return self.entries().groupBy("tenant_id").agg(F.count("*").alias("requests"), F.count_if("accepted").alias("accepted"), consumed.alias("consumed"), (total - consumed).alias("remaining"))

    def release(self, requests: DataFrame, order: list[str], noise_key: bytes, query: str, candidates: DataFrame | None = None) -> DataFrame:
        """The entries of requests, those answered before with their first answer.

        requests are (tenant_id, request_id, kind, epsilon, total, the columns of order) and, as their kind needs them, true_value, true_count, sensitivity and
        delta; candidates are (tenant_id, request_id, candidate, utility) for selections. Parameters that allow no noise are refused with a reason and
        cost nothing, as is what the balance can't pay. Noise is drawn by HMAC from (query, request, tenant), so it is fixed for an entry and
        differs between any two. A request that a call repeats counts once, by the first in order. Null tenants and requests are refused by an error.

        Counts get Laplace noise, sums and averages Gaussian noise, selections are the largest of utility plus Gumbel noise.
        """
        asked = requests
        for name, value in DEFAULTS.items():
            given = F.col(name).cast("double") if name in requests.columns else F.lit(None).cast("double")
            asked = asked.withColumn(name, F.coalesce(given, F.lit(value)) if value is not None else given)
        must = lambda c: F.when(F.col(c).isNull(), F.raise_error(F.lit(f"{c} is null")).cast("string")).otherwise(F.col(c).cast("string"))
        asked = asked.withColumns({"tenant_id": must("tenant_id"), "request_id": must("request_id")})
        known = self.entries()
        first = F.row_number().over(Window.partitionBy("tenant_id", "request_id").orderBy(*order))
        fresh = asked.withColumn("__nth", first).filter("__nth = 1").drop("__nth").join(known.select("tenant_id", "request_id"), ["tenant_id", "request_id"], "left_anti")
        fresh = stored(fresh.withColumn("reason", refusal()), "requests")
        if fresh.limit(1).count():
            balance = known.groupBy("tenant_id").agg(F.max("consumed").alias("spent"))
            # A number for the fold, in which the order of requests is kept by the columns of order.
            numbered = fresh.join(balance, "tenant_id", "left").withColumns({"seq": F.xxhash64("tenant_id", "request_id"), "epsilon": F.when(F.col("reason").isNull(), F.col("epsilon")).otherwise(-1.0), "total": F.coalesce("total", F.lit(0.0))})
            paid = budget_fold(numbered, [*order, "request_id"]).select("tenant_id", "seq", "accepted", "remaining", "warning")
            rows = fresh.withColumn("seq", F.xxhash64("tenant_id", "request_id")).join(paid, ["tenant_id", "seq"]).drop("seq")
            rows = with_keys(rows, n=noise_key)
            if candidates is not None:
                rows = rows.join(self.selections(rows, candidates, query), ["tenant_id", "request_id"], "left")
            else:
                rows = rows.withColumn("best", F.lit(None).cast("string"))
            said = F.col("accepted")
            out = rows.select(
                "tenant_id", "request_id", "kind", "epsilon", "total", "accepted", F.when(said, F.lit(None).cast("string")).otherwise(F.coalesce("reason", F.lit("budget exhausted"))).alias("reason"), (F.col("total") - F.col("remaining")).alias("consumed"), "remaining", "warning",
                F.when(said & (F.col("kind") != "select"), noisy(query)).alias("answer"), F.when(said, F.col("best")).alias("selected"),
            )
            number = max(self.batches(), default=0) + 1
            out.write.mode("errorifexists").parquet(f"{self.folder}/batch={number}")
        dropped(fresh)
        ids = asked.select("tenant_id", "request_id").distinct()
        return self.entries().join(ids, ["tenant_id", "request_id"], "left_semi")

    @staticmethod
    def selections(rows: DataFrame, candidates: DataFrame, query: str) -> DataFrame:
        """(tenant_id, request_id, best) of the accepted selections: the exponential mechanism by Gumbel noise."""
        wanted = rows.filter("accepted AND kind = 'select'").select("tenant_id", "request_id", "epsilon", "sensitivity", *[c for c in rows.columns if c.startswith("__key_")])
        each = candidates.select(F.col("tenant_id").cast("string").alias("tenant_id"), F.col("request_id").cast("string").alias("request_id"), "candidate", F.col("utility").cast("double").alias("utility")).join(wanted, ["tenant_id", "request_id"])
        u = uniform(key("n"), F.lit(query), F.col("request_id"), F.col("tenant_id"), F.col("candidate"))
        gumbel = -F.log(-F.log(F.least(F.greatest(u, F.lit(2.0**-60)), F.lit(1 - 2.0**-53))))
        return each.groupBy("tenant_id", "request_id").agg(F.max_by("candidate", F.col("epsilon") / (2 * F.col("sensitivity")) * F.col("utility") + gumbel).alias("best"))


def refusal() -> Column:
    """Why a request's parameters allow no answer; null if they do."""
    kind = F.col("kind")
    gauss = kind.isin("sum", "average")
    return (
        F.when(~kind.isin(*KINDS) | kind.isNull(), "unknown kind")
        .when(~F.coalesce(F.col("epsilon") > 0, F.lit(False)), "epsilon must be positive")
        .when(~F.coalesce(F.col("total") > 0, F.lit(False)), "budget must be positive")
        .when(~(F.col("sensitivity") > 0), "sensitivity must be positive")
        .when(gauss & ~((F.col("delta") > 0) & (F.col("delta") < 1)), "delta must be between 0 and 1")
        .when((kind == "average") & ~F.coalesce(F.col("true_count") >= 1, F.lit(False)), "count must be at least 1")
        .when((kind != "select") & F.col("true_value").isNull(), "no value")
    )


def noisy(query: str) -> Column:
    """The true value with the noise of its kind."""
    draw = lambda n: uniform(key("n"), F.lit(query), F.col("request_id"), F.col("tenant_id"), F.lit(n))
    scale = F.when(F.col("kind") == "average", F.col("sensitivity") / F.col("true_count")).otherwise(F.col("sensitivity"))
    x = draw("1") - 0.5
    laplace = -(scale / F.col("epsilon")) * F.signum(x) * F.log(F.greatest(1 - 2 * F.abs(x), F.lit(2.0**-60)))
    sigma = scale * F.sqrt(2 * F.log(F.lit(1.25) / F.col("delta"))) / F.col("epsilon")
    gauss = sigma * F.sqrt(-2 * F.log(F.greatest(draw("1"), F.lit(2.0**-60)))) * F.cos(2 * F.lit(3.141592653589793) * draw("2"))
    return F.col("true_value") + F.when(F.col("kind") == "count", laplace).otherwise(gauss)
