"""Re-triage of changed logs as a scheduled batch job (S3, Z3).

Spark's file stream source never re-reads a file that changes under a known
path, so changes are found by listing: the current listing (path, mtime;
file content is pruned from the scan) is compared with the last manifest
version, changed or new files are read whole, and the upserted manifest becomes the next
version only after their results are written (``Scan.commit``). A scan that dies before that
is simply made again. A version is never overwritten in place; the manifest
lives under a folder the caller names (on a cluster: shared storage).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.analyze import release
from ..session import ensure_checkpoint_dir
from ..sources.files import LINE_SCHEMA, changed_files, file_listing, job_column, read_logs
from .watch import triage_batch, utc_now

_VERSION = re.compile(r"v=(\d+)$")


def _versions(spark: SparkSession, manifest_dir: str) -> list[int]:
    """Manifest versions present under ``manifest_dir`` (Hadoop FS listing)."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(manifest_dir)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    out = []
    for st in fs.listStatus(path):
        m = _VERSION.search(st.getPath().getName())
        if m and fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")):
            out.append(int(m.group(1)))
    return sorted(out)


@dataclass
class Scan:
    """Lines of the new or changed logs, and the manifest that says they were seen."""

    lines: DataFrame
    manifest: DataFrame
    version: int
    manifest_dir: str

    def commit(self) -> int:
        """Write the manifest as its version: call it once the lines' results are safe."""
        self.manifest.write.mode("error").parquet(f"{self.manifest_dir}/v={self.version}")
        return self.version


def rescan(spark: SparkSession, logs_path: str, manifest_dir: str, glob: str = "*.log",
           job: str = "path") -> Scan:
    """The logs that are new or changed since the last manifest version.

    ``lines`` is a normal lines table (read whole, numbered exactly), ready for ``analyze`` /
    ``triage_report``. The folder is read (with one file per job, files older than the oldest change are
    pruned at listing) and semi-joined with what changed; no path list comes to the driver, and names
    may hold any character. The listing is taken once and kept in the shared checkpoint folder, so that
    what is read and what is committed agree.
    """
    manifest_dir = manifest_dir.rstrip("/")
    ensure_checkpoint_dir(spark)
    listing = file_listing(spark, logs_path, glob).select("path", "mtime").checkpoint()
    versions = _versions(spark, manifest_dir)
    if versions:
        manifest = spark.read.parquet(f"{manifest_dir}/v={versions[-1]}")
    else:
        manifest = spark.createDataFrame([], "path string, mtime timestamp")
    changed, new_manifest = changed_files(listing, manifest)
    version = (versions[-1] + 1) if versions else 0
    oldest = changed.agg(F.date_format(F.min("mtime") - F.expr("INTERVAL 2 SECONDS"), "yyyy-MM-dd'T'HH:mm:ss")).first()[0]
    if oldest is None:
        lines = spark.createDataFrame([], LINE_SCHEMA)
    elif job == "path":
        lines = read_logs(spark, logs_path, glob, job, oldest, changed.select(F.col("path").alias("job_id")))
    else:  # a job of several files is read whole when one of them changes
        jobs = changed.select(job_column(F.col("path"), job).alias("job_id")).distinct()
        lines = read_logs(spark, logs_path, glob, job, only=jobs)
    return Scan(lines, new_manifest, version, manifest_dir)


def rescan_to_outbox(spark: SparkSession, logs_path: str, manifest_dir: str, out: str, glob: str = "*.log",
                     job: str = "path", as_of: str | None = None, **how) -> int:
    """One scheduled run: changed logs -> skip tiny -> analysis -> gate -> alerts under ``out/scan=N``, and only
    then the manifest version N, which is returned. After a failure the next run takes the same logs again."""
    scan = rescan(spark, logs_path, manifest_dir, glob, job)
    rows = triage_batch(scan.lines, as_of or utc_now(spark), **how)
    try:
        rows.write.mode("overwrite").parquet(f"{out.rstrip('/')}/scan={scan.version}")
    finally:
        release(rows)
    return scan.commit()
