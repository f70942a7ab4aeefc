"""Token counts as delta-maintained rollups.

A batch of signed changes (an insert adds a document's tokens, a delete takes them away, a revision takes the old count
away and adds the new one) is summed by source, language and tokenizer version, and committed under its name. A ledger keeps what
each document was counted as, so that a revision or a delete needs only the doc_id. Totals are the sums of a base and of the batches behind it;
compaction makes a new base of both, of sums, of each document's last rows in the ledger and of the batches' names.

A commit writes its files to a folder of its own and then publishes them as the log's next number, by renaming a file that names batch
and folder; a rename fails where that number is taken, so only one writer gets it. A loser reads the log again: if its batch
is there by now, it has been committed; if not, changes that depend on the ledger are worked out anew from what was committed since. So a
batch that is retried, sent twice or written by two at once counts once, batches that revise a document at once count one
after the other, and files of an interrupted commit are never read. A base holds the log up to one number, whatever is
committed meanwhile. The folder must be on a file system whose rename is atomic.

Null sources and languages are groups of their own. Rows that repeat a doc_id in a batch count each, and later changes
concern them all; rows without a doc_id are inserted and can't be changed again. Null text has no tokens. Groups whose sums are
zero are left out of totals. A log without batches has no totals; an empty batch changes nothing. Columns of the input
other than those named are not read.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import vocabulary
from .common import saved, shared_dir, slices, table

KEYS = ["source", "lang", "tokenizer"]
SCHEMA = "source string, lang string, tokenizer string, docs long, tokens long"
ROWS = "doc_id long, source string, lang string, tokenizer string, tokens long"
LEDGER = "doc_id long, seq long, source string, lang string, tokenizer string, tokens long"
#: Tokenizer versions and the rank files of their vocabularies.
TOKENIZERS = {"byte-50k": "byte_bpe_50k.tiktoken", "byte-multi-50k": "byte_bpe_multi_50k.tiktoken"}


def counted(docs: DataFrame, version: str, path: str | None = None) -> DataFrame:
    """(doc_id, source, lang, tokenizer, tokens) of documents (doc_id, source, lang, text); path: of the version's rank file."""
    path = path or vocabulary(TOKENIZERS[version])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encode = tiktoken.Encoding("counts", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for batch in slices(batches):
            n = pa.array([len(encode(t)) if t else 0 for t in batch.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "source", "lang")), pa.array([version] * len(n), pa.string()), n], names=["doc_id", *KEYS, "tokens"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), "text")
    return own.mapInArrow(run, "doc_id long, source string, lang string, tokenizer string, tokens long")


@dataclass(frozen=True)
class State:
    """The log at one time: a base of all up to number `at`, and the batches (name, folder) behind it by number."""

    at: int
    base: str | None
    behind: dict[int, tuple[str, str]]

    @property
    def next(self) -> int:
        return max([self.at, *self.behind]) + 1


class Rollup:
    """Totals in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self._read = spark, path, {}

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return fs, fs.makeQualified(p)

    def _entries(self, kind: str, above: int = 0) -> dict[int, list[str]]:
        """Published numbers above one, and the words of each."""
        fs, root = self._fs(f"{self.path}/{kind}")
        names = [x.getPath().getName() for x in fs.listStatus(root)] if fs.exists(root) else []
        found = {}
        for n in sorted(int(n) for n in names if n.isdigit() and int(n) > above):
            if (kind, n) not in self._read:  # entries never change
                file = fs.open(self._fs(f"{self.path}/{kind}/{n:010d}")[1])
                self._read[kind, n] = file.readLine().split(" ")
                file.close()
            found[n] = self._read[kind, n]
        return found

    def _publish(self, kind: str, number: int, *words: str) -> bool:
        """Whether the number is this writer's; its words are whole as soon as others see it."""
        fs, done = self._fs(f"{self.path}/{kind}/{number:010d}")
        _, draft = self._fs(f"{self.path}/{kind}/_{uuid.uuid4().hex}")
        file = fs.create(draft, False)
        file.writeBytes(" ".join(words))
        file.close()
        jvm = self.spark._jvm
        options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(done.toUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, done, options)
        except Py4JJavaError as e:
            fs.delete(draft, False)
            if "FileAlreadyExistsException" not in e.java_exception.getClass().getName():
                raise
            return False
        return True

    def _state(self) -> State:
        bases = self._entries("bases")
        at = max(bases, default=0)
        return State(at, bases[at][0] if bases else None, {n: (w[0], w[1]) for n, w in self._entries("log", at).items()})

    def _knows(self, state: State, batch: str) -> bool:
        if any(b == batch for b, _ in state.behind.values()):
            return True
        return state.base is not None and not self.spark.read.parquet(f"{self.path}/base/{state.base}/batches").where(F.col("batch") == batch).isEmpty()

    def _tables(self, state: State, kind: str, schema: str) -> DataFrame:
        """Rows of sums or ledger of the base and all batches behind it."""
        paths = [f"{self.path}/{kind}/{folder}" for _, folder in state.behind.values()]
        paths += [f"{self.path}/base/{state.base}/{kind}"] if state.base else []
        paths = [p for p in paths if self._fs(p)[0].exists(self._fs(p)[1])]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _forget(self, *paths: str) -> None:
        for path in paths:
            fs, p = self._fs(f"{self.path}/{path}")
            fs.delete(p, True)

    def _commit(self, batch: str, changes: Callable[[State], tuple[DataFrame, DataFrame | None]], again: bool) -> bool:
        """Publishes changes (of a state: signed sums, rows of the ledger), worked out again after another writer's commit if asked."""
        if not re.fullmatch(r"[\w.-]+", batch):
            raise ValueError("a batch is named by letters, digits, '.', '_' and '-'")
        folder = None
        while True:
            state = self._state()
            if self._knows(state, batch):
                if folder:
                    self._forget(f"sums/{folder}", f"ledger/{folder}")
                return False
            if folder is None:
                folder = uuid.uuid4().hex
                signed, ledger = changes(state)
                signed.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).write.parquet(f"{self.path}/sums/{folder}")
                if ledger is not None:
                    ledger.write.parquet(f"{self.path}/ledger/{folder}")
            if self._publish("log", state.next, batch, folder):
                return True
            if again:
                self._forget(f"sums/{folder}", f"ledger/{folder}")
                folder = None

    def batches(self) -> list[str]:
        """Names of all committed batches, a row for each."""
        state = self._state()
        held = [r.batch for r in self.spark.read.parquet(f"{self.path}/base/{state.base}/batches").collect()] if state.base else []
        return sorted([*held, *(b for b, _ in state.behind.values())])

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Adds changes (source, lang, tokenizer, docs, tokens), signed. False if the batch was committed before: nothing happens then."""
        return self._commit(batch, lambda state: (changes, None), False)

    def counted_as(self, ids: DataFrame, state: State | None = None) -> DataFrame:
        """(doc_id, source, lang, tokenizer, tokens): what documents of ids (doc_id) count as, now or in a state."""
        rows = self._tables(state or self._state(), "ledger", LEDGER).join(ids.select("doc_id").distinct(), "doc_id", "left_semi")
        return self._last(rows).where("tokenizer is not null").drop("seq")

    @staticmethod
    def _last(rows: DataFrame) -> DataFrame:
        return rows.join(rows.groupBy("doc_id").agg(F.max("seq").alias("seq")), ["doc_id", "seq"])

    def apply(self, batch: str, rows: DataFrame | None = None, deletes: DataFrame | None = None) -> bool:
        """Inserts or revises rows (doc_id, source, lang, tokenizer, tokens) and takes deletes (doc_id) away."""
        none = self.spark.createDataFrame([], ROWS)
        rows = none if rows is None else rows.select(*none.columns)
        gone = (none if deletes is None else deletes).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
        kept = rows.join(gone, "doc_id", "left_anti")
        signed = lambda df, sign: df.select(*KEYS, F.lit(sign).cast("long").alias("docs"), (F.col("tokens") * sign).alias("tokens"))
        empty = [F.lit(None).cast("string").alias(k) for k in KEYS]

        def changes(state: State) -> tuple[DataFrame, DataFrame]:
            seq = F.lit(state.next).cast("long").alias("seq")
            old = self.counted_as(rows.select("doc_id").union(gone), state)
            ledger = kept.where("doc_id is not null").select("doc_id", seq, *KEYS, "tokens").union(gone.select("doc_id", seq, *empty, F.lit(None).cast("long")))
            return signed(old, -1).union(signed(kept, 1)), ledger

        return self._commit(batch, changes, True)

    def totals(self, state: State | None = None) -> DataFrame:
        rows = self._tables(state or self._state(), "sums", SCHEMA)
        return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0")

    def compact(self) -> bool:
        """A new base of the last one and all batches behind it; False if nothing is behind it or another writer was faster."""
        state, folder = self._state(), uuid.uuid4().hex
        if not state.behind:
            return False
        names = self.spark.createDataFrame([(b,) for b, _ in state.behind.values()], "batch string")  # a row for each batch since the last base
        names = names.union(self.spark.read.parquet(f"{self.path}/base/{state.base}/batches")) if state.base else names
        self.totals(state).write.parquet(f"{self.path}/base/{folder}/sums")
        self._last(self._tables(state, "ledger", LEDGER)).where("tokenizer is not null").select(*[c.split()[0] for c in LEDGER.split(", ")]).write.parquet(f"{self.path}/base/{folder}/ledger")
        names.write.parquet(f"{self.path}/base/{folder}/batches")
        if self._publish("bases", state.next - 1, folder):
            return True
        self._forget(f"base/{folder}")
        return False

    def clean(self) -> None:
        """Deletes files of batches and bases that the last base holds; no reader or writer that began before it may still run."""
        state = self._state()
        for n, (_, folder) in self._entries("log").items():
            if n <= state.at:
                self._forget(f"sums/{folder}", f"ledger/{folder}")
        self._forget(*(f"base/{w[0]}" for n, w in self._entries("bases").items() if n < state.at))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document is inserted; those not in English are revised to another tokenizer; toxic ones are withdrawn; one batch comes twice."""
    docs = table(spark, sf_dir, "documents")
    log = Rollup(spark, f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}")
    revision = saved(counted(docs.where(~F.col("lang").eqNullSafe("en")), "byte-multi-50k"))
    log.apply("0-insert", saved(counted(docs, "byte-50k")))
    log.apply("1-revise", revision)
    log.compact()
    log.apply("2-delete", deletes=table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id"))
    log.apply("1-revise", revision)
    return log.totals()


QUERIES = {"op5_token_counts": op5_token_counts}
ORACLES: dict[str, str] = {}
