"""Token totals by source, language and tokenizer version, kept up to date by signed changes.

A store is a folder of tables: ``ledger/attempt=…`` holds the counts a batch set, ``deltas/attempt=…`` what it
added to the totals, ``refused/attempt=…`` how many of its rows were refused and why. ``commits/<number>`` is one marker
per finished batch, which names the batch and the attempt that counts. Totals are the sums of all committed deltas, so
they never need the documents again. A batch that is already committed changes nothing; one that failed half-way
leaves folders that no marker names. Markers are created exclusively: of two writers with the same number one
gets it, the other computes its batch again on top of the first. Batch names may hold any characters.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LEDGER = "doc_id bigint, version string, source string, lang string, n_tokens bigint, alive boolean"
_DELTAS = "source string, lang string, version string, documents bigint, tokens bigint"
_REFUSED = "reason string, n bigint"
_OPS = ("insert", "revise", "delete")


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _markers(self) -> dict[int, dict]:
        """Number -> {batch, attempt}. A marker without content belongs to a writer that died; its number is spent."""
        fs, p = self._fs(f"{self.path}/commits")
        out = {}
        for status in fs.listStatus(p) if fs.exists(p) else ():
            if status.getPath().getName().isdigit():
                stream = fs.open(status.getPath())
                try:
                    content = bytes(self.spark._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream))
                finally:
                    stream.close()
                out[int(status.getPath().getName())] = json.loads(content) if content else {}
        return out

    def _claim(self, seq: int, marker: dict) -> bool:
        """Create the marker of this number unless it is there."""
        fs, p = self._fs(f"{self.path}/commits/{seq:09d}")
        try:
            out = fs.create(p, False)
        except Py4JJavaError as e:
            if fs.exists(p):
                return False
            raise e
        out.write(bytearray(json.dumps(marker).encode("utf-8")))
        out.close()
        return True

    def committed(self) -> dict[str, int]:
        """Batch name -> sequence number."""
        return {m["batch"]: n for n, m in self._markers().items() if m}

    def _tables(self, kind: str, schema: str, markers: dict[int, dict]) -> DataFrame:
        paths = [f"{self.path}/{kind}/attempt={m['attempt']}" for _, m in sorted(markers.items()) if m]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _states(self, markers: dict[int, dict], among: DataFrame | None = None) -> DataFrame:
        """The last state of every document and version, or only of those in ``among(doc_id, version)``."""
        rows, key = self._tables("ledger", _LEDGER, markers), ["doc_id", "version"]
        numbers = F.create_map(F.lit(""), F.lit(0), *[F.lit(x) for n, m in sorted(markers.items()) if m for x in (m["attempt"], n)])
        rows = rows.withColumn("seq", F.try_element_at(numbers, F.regexp_extract(F.input_file_name(), r"attempt=([0-9a-f]{32})/[^/]*$", 1)))
        if among is not None:
            rows = rows.join(among, key, "left_semi")
        last = F.max(F.struct("seq", "source", "lang", "n_tokens", "alive")).alias("s")
        return rows.groupBy(*key).agg(last).select(*key, "s.source", "s.lang", "s.n_tokens", "s.alive", "s.seq")

    def ledger(self) -> DataFrame:
        """The last committed state of every document and version."""
        return self._states(self._markers())

    def refused(self) -> DataFrame:
        """(batch, reason, n): rows that committed batches held without an id or a version."""
        markers = self._markers()
        names = self.spark.createDataFrame([(m["attempt"], m["batch"]) for m in markers.values() if m], "attempt string, batch string")
        rows = self._tables("refused", _REFUSED, markers).withColumn("attempt", F.regexp_extract(F.input_file_name(), r"attempt=([0-9a-f]{32})/[^/]*$", 1))
        return rows.join(F.broadcast(names), "attempt").groupBy("batch", "reason").agg(F.sum("n").alias("n"))

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply ``changes(op, doc_id, version, source, lang, n_tokens)`` once; False if the batch is known.

        ``op`` is insert, revise or delete; any other, null included, is a ValueError and nothing is committed. An insert
        of a known document is a revision, a revision of an unknown one an insert, a delete of an unknown one nothing.
        Of several changes to one document and version in a batch a delete wins, then the largest count. Null counts
        are 0; rows with a null id or version are refused and counted in ``refused()``. Null sources and languages are
        groups. Further columns are ignored; a batch without rows is committed and adds nothing.
        """
        markers = self._markers()
        if batch in {m.get("batch") for m in markers.values()}:
            return False
        attempt = uuid.uuid4().hex
        path = {kind: f"{self.path}/{kind}/attempt={attempt}" for kind in ("ledger", "deltas", "refused")}

        known = F.coalesce(F.col("op").isin(*_OPS), F.lit(False))
        reason = F.when(~known, "unknown op").when(F.col("doc_id").isNull(), "null id").when(F.col("version").isNull(), "null version")
        changes.select(reason.alias("reason")).where("reason is not null").groupBy("reason").agg(
            F.count("*").alias("n")).write.parquet(path["refused"])
        if not self.spark.read.schema(_REFUSED).parquet(path["refused"]).where("reason = 'unknown op'").isEmpty():
            raise ValueError(f"batch {batch!r} holds changes that are none of {', '.join(_OPS)}")

        # The smallest of these structs is the change that counts; copies of one key collapse before the shuffle.
        first = F.min(F.struct(
            (F.col("op") != "delete").alias("alive"), (-F.coalesce("n_tokens", F.lit(0)).cast("bigint")).alias("less"), "source", "lang")).alias("c")
        once = changes.where(known & F.col("doc_id").isNotNull() & F.col("version").isNotNull()).groupBy("doc_id", "version").agg(first)
        once.select("doc_id", "version", "c.source", "c.lang", (-F.col("c.less")).alias("n_tokens"), "c.alive").write.parquet(path["ledger"])
        new = self.spark.read.schema(_LEDGER).parquet(path["ledger"])

        while True:
            seq = max(markers, default=0) + 1
            signed = new.where("alive").select("source", "lang", "version", F.lit(1).alias("documents"), F.col("n_tokens").alias("tokens"))
            if any(markers.values()):
                old = self._states(markers, new.select("doc_id", "version")).where("alive")
                signed = signed.unionByName(old.select("source", "lang", "version", F.lit(-1).alias("documents"), (-F.col("n_tokens")).alias("tokens")))
            deltas = signed.groupBy("source", "lang", "version").agg(
                F.sum("documents").cast("bigint").alias("documents"), F.sum("tokens").cast("bigint").alias("tokens"))
            deltas.where("documents <> 0 or tokens <> 0").write.mode("overwrite").parquet(path["deltas"])
            if self._claim(seq, {"batch": batch, "attempt": attempt}):
                return True
            # Another writer took the number: its batch comes first, and may be this one.
            markers = self._markers()
            if batch in {m.get("batch") for m in markers.values()}:
                return False

    def totals(self) -> DataFrame:
        """(source, lang, version, documents, tokens) over all committed batches, without empty groups."""
        return self._tables("deltas", _DELTAS, self._markers()).groupBy("source", "lang", "version").agg(
            F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")).where("documents <> 0 or tokens <> 0")


def blank_words(text: Column) -> Column:
    """Words between ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def letter_runs(text: Column) -> Column:
    """Runs of ASCII letters, runs of ASCII digits and single other characters that are no white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9\x20\x09-\x0D]")), F.lit(0)).cast("bigint")


def changes(docs: DataFrame, op: str, version: str, count: Column) -> DataFrame:
    return docs.select(F.lit(op).alias("op"), F.col("doc_id").cast("bigint").alias("doc_id"), F.lit(version).alias("version"),
                       "source", "lang", count.alias("n_tokens"))
