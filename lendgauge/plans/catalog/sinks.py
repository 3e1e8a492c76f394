"""Queries that write through the sinks to the shared folder and read back what was written."""

from pyspark.sql import functions as F

from ...operators import clean, monitor, psi
from ...session import new_place
from ...sources import tables
from ..loanbook import applications
from .models import SCORED, scored
from .registry import QUERIES, STATEMENTS, on_app, query, rounded
from .tables import FEATURES


@query("snapshot_written", STATEMENTS["impute_values"])
def snapshot_written(spark, folder):
    filled = clean.impute(applications(spark, folder, ["app_id", *FEATURES]), -999.0, ["n_ret"])
    return tables.read_table(spark, tables.write_snapshot(filled, new_place(spark, "app") + ".parquet"))


@query("snapshot_written_csv", STATEMENTS["impute_values"])
def snapshot_written_csv(spark, folder):
    filled = clean.impute(applications(spark, folder, ["app_id", *FEATURES]), -999.0, ["n_ret"])
    return tables.read_table(spark, tables.write_snapshot(filled, new_place(spark, "app") + ".csv"), filled.schema)


@query("psi_detail_csv", STATEMENTS["psi_detail"])
def psi_detail_csv(spark, folder):
    app = applications(spark, folder, ["amount", "target"])
    detail = psi.psi_detail(app, "amount", F.col("target") == "train", F.col("target") == "oot")
    path = tables.write_csv_detail(detail, new_place(spark, "psi") + ".csv")
    return rounded(tables.read_table(spark, path, detail.schema).drop("score_range"))


BATCHES = ("valid", "oot")


@query("batch_logs", on_app(
    "SELECT target AS batch_name, COUNT(*) AS sample_size, round(avg(score), 6) AS avg_score, round(min(score), 6) AS min_score, "
    "round(max(score), 6) AS max_score FROM scored WHERE target IN ('valid', 'oot') GROUP BY target", SCORED))
def batch_logs(spark, folder):
    app, path = scored(spark, folder, ["target"]), new_place(spark, "log")
    for name in BATCHES:
        tables.append_log(monitor.monitor_scores(app.where(F.col("target") == name), None), path, name)
    return rounded(tables.read_table(spark, path + "/*.parquet").select("batch_name", "sample_size", "avg_score", "min_score", "max_score"))


@query("report_sections_written", STATEMENTS["psi_compact"])
def report_sections_written(spark, folder):
    sections = {name: QUERIES[name](spark, folder) for name in ("psi_compact", "psi_filter")}
    paths = tables.write_sections(sections, new_place(spark, "report"))
    return tables.read_table(spark, paths["psi_compact"] + "/*.parquet")
