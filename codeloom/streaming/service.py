"""Requests as JSON lines, answered in batches: from a stream or a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codeloom import schemas
from codeloom.operators import fixing
from codeloom.session import scratch

#: The commands, the answer about them and the texts of failures are fixed by the protocol.
COMMANDS = ("get_capabilities", "fix_code_in_file")
CAPABILITIES = (
    '{"fix_code_in_file":{"version":0.1,"inputs":["source","filename"],"outputs":["replacements","inserts","deletions"]},'
    '"get_capabilities":{"version":0.1,"inputs":[],"outputs":["capabilities"]}}'
)


def routed(lines: DataFrame) -> DataFrame:
    """value, the fields of the request, command (what handles it) and failure (why nothing does)."""
    r = lines.select("value", F.from_json("value", schemas.REQUEST, {"mode": "PERMISSIVE"}).alias("r")).select("value", "r.*")
    empty = F.col("request_id").isNull() | F.col("request_id").isin("", "0", "false")
    failure = (
        F.when(~F.coalesce(F.try_parse_json("value").isNotNull(), F.lit(False)), "Not a JSON object").when(empty, "Empty request id")
        .when(F.col("command_id").isNull(), "Invalid command_id").when(~F.col("command_id").isin(*COMMANDS), F.concat(F.lit('"'), "command_id", F.lit('" is not a valid command_id.')))
        .when((F.col("command_id") == "fix_code_in_file") & (F.col("source").isNull() | F.col("filename").isNull()), "source and filename are needed")
    )
    return r.withColumn("failure", failure).withColumn("command", F.when(F.col("failure").isNull(), F.col("command_id")))


def answers(lines: DataFrame, index: DataFrame) -> DataFrame:
    """id, result_code (0 is success), response: one JSON object for each request line."""
    r = routed(lines).withColumn("file_id", F.xxhash64("request_id", "filename", "value"))
    files = r.filter("command = 'fix_code_in_file'").select("file_id", F.col("filename").alias("path"), "source").dropDuplicates(["file_id"])
    fixed = fixing.fix_files(files, index).select("file_id", "edits", "error")
    out = r.join(fixed, "file_id", "left").withColumn("failure", F.coalesce("failure", "error"))

    def part(kind: str):
        return F.filter(F.coalesce("edits", F.array().cast(f"array<{fixing.EDIT}>")), lambda e: e["kind"] == kind)

    code = F.when(F.col("failure").isNull(), 0).otherwise(1)
    ident = F.coalesce("request_id", F.lit("-1"))
    bad = F.to_json(F.struct(ident.alias("id"), code.alias("result_code"), F.col("failure").alias("failure_reason")))
    caps = F.concat(F.lit('{"id":"'), ident, F.lit('","result_code":0,"capabilities":' + CAPABILITIES + "}"))
    fix = F.to_json(F.struct(ident.alias("id"), code.alias("result_code"), part("replace").alias("replacements"), part("insert").alias("inserts"), part("delete").alias("deletions")))
    response = F.when(F.col("failure").isNotNull(), bad).when(F.col("command") == "get_capabilities", caps).otherwise(fix)
    return out.select(ident.alias("id"), code.alias("result_code"), response.alias("response"))


def serve(lines: DataFrame, index: DataFrame, out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Answers a stream of lines; successes go to out/ok, failures to out/failed. A batch that is repeated after a failure
    replaces what it wrote before, and no bad request stops the service."""

    def batch(rows: DataFrame, n: int) -> None:
        with scratch(rows.sparkSession):  # what a batch needs on its way is gone with it
            done = answers(rows, index).persist()
            try:
                for name, ok in (("ok", 0), ("failed", 1)):
                    done.filter(F.col("result_code") == ok).select(F.col("response").alias("value")).write.mode("overwrite").text(f"{out}/{name}/batch={n}")
            finally:
                done.unpersist()

    w = lines.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime="1 second")).start()
