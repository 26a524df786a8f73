"""Quality rules with cross-document line frequency.

Base rules look at one text. The method hashes normalised lines, counts the
distinct documents of each host that carry a line, removes lines above the
limits, and rejects documents that this depletes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanwork.llm._shared import bound_batches, byte_values, materialise, own_columns

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\r\x0b\x0c"

#: A line counts as boilerplate of its host if this many distinct documents of
#: the host hold it, and this share of them, however long it is. Where the share
#: would ask for more than ENOUGH_DOCS documents, these are enough.
MIN_DOCS = 20
MIN_SHARE = 0.005
ENOUGH_DOCS = 1000
#: A document that loses more than this share of its words is depleted.
MAX_LOST = 0.5
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeat_words(words: list[bytes]) -> int:
    """Words inside a three-word window that the text holds twice or more."""
    n = len(words) - 2
    if n < 2:
        return 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == n:
        return 0
    often = {w for w, k in Counter(windows).items() if k > 1}
    covered, upto = 0, 0
    for i, w in enumerate(windows):
        if w in often:
            covered += i + 3 - max(i, upto)
            upto = i + 3
    return covered


def line_hash(words: list[bytes]) -> int:
    """Signed 64-bit hash of a line in lower case with single spaces."""
    line = b" ".join(words)
    line = line.lower() if line.isascii() else line.decode("utf-8", "replace").lower().encode()
    return xxhash.xxh3_64_intdigest(line) - (1 << 63)


def text_stats(text: bytes) -> tuple[list[int], dict[int, int]]:
    """[n_words, space-free bytes, n_symbols, n_dup_lines, n_repeat_words], and the words of each line's hash."""
    words = text.split()
    seen: set[bytes] = set()
    dup = 0
    lines: dict[int, int] = {}
    for line in text.split(b"\n"):
        own = line.split()
        if not own:
            continue
        if line in seen:
            dup += 1
        else:
            seen.add(line)
        h = line_hash(own)
        lines[h] = lines.get(h, 0) + len(own)
    spaces = len(text) - len(text.translate(None, SPACES))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    return [len(words), spaces, symbols, dup, repeat_words(words)], lines


STAT_SCHEMA = "doc_id long, host string, text_hash long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<struct<hash:long,words:long>>"


def line_stats(docs: DataFrame) -> DataFrame:
    """One row for each input row: base figures and the hashes of its lines."""
    lines_type = pa.list_(pa.struct([("hash", pa.int64()), ("words", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(2)
            points = pc.utf8_length(text).fill_null(0).to_pylist()
            rows: dict[str, list] = {k: [] for k in ("text_hash", *STATS, "lines")}
            for data, n in zip(byte_values(text), points, strict=True):
                (words, spaces, symbols, dup, repeat), lines = text_stats(data)
                rows["text_hash"].append(xxhash.xxh3_64_intdigest(data) - (1 << 63))
                for k, v in zip(STATS, (words, n - spaces, symbols, dup, repeat), strict=True):
                    rows[k].append(v)
                rows["lines"].append([{"hash": h, "words": w} for h, w in lines.items()])
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0), "host": batch.column(1),
                **{k: pa.array(v, pa.int64()) for k, v in rows.items() if k != "lines"},
                "lines": pa.array(rows["lines"], lines_type),
            })

    return docs.mapInArrow(run, STAT_SCHEMA)


def frequent_lines(stats: DataFrame, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE, enough: int = ENOUGH_DOCS) -> DataFrame:
    """``host, hash, first_doc`` of the lines above the limits.

    Documents are told apart by ``doc_id``, those without one by their text.
    The key is first made distinct with the document in it, so a line that all
    documents share is counted by many tasks, and only partial counts meet. A
    null host is a host of its own.
    """
    document = ["doc_id", "nameless"]
    held = stats.select("host", "doc_id", F.when(F.col("doc_id").isNull(), F.col("text_hash")).alias("nameless"), "lines")
    hosts = held.select("host", *document).distinct().groupBy("host").agg(F.count("*").alias("host_docs"))
    carried = held.select("host", *document, F.explode("lines.hash").alias("hash")).distinct()
    counted = carried.groupBy("host", "hash").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))
    counted = counted.where(F.col("n_docs") >= min_docs).alias("c")
    joined = counted.join(hosts.alias("h"), F.col("c.host").eqNullSafe(F.col("h.host")))
    return joined.where(F.col("n_docs") >= F.least(min_share * F.col("host_docs"), F.lit(float(enough)))).select("c.host", "hash", "first_doc")


def lost_lines(stats: DataFrame, frequent: DataFrame) -> DataFrame:
    """``doc_id, host, text_hash, lost_words, lost_hashes`` of the texts that hold a removed line; one row for each such text.

    The first document of a host that carries a line keeps it.
    """
    own = stats.select("doc_id", "host", "text_hash", F.explode("lines").alias("line")).select("*", F.col("line.hash").alias("hash"), F.col("line.words").alias("words")).drop("line").alias("o")
    met = own.join(frequent.alias("f"), (F.col("o.hash") == F.col("f.hash")) & F.col("o.host").eqNullSafe(F.col("f.host")))
    met = met.where(~F.col("o.doc_id").eqNullSafe(F.col("first_doc"))).select("o.doc_id", "o.host", "o.text_hash", "o.hash", "words").distinct()
    return met.groupBy("doc_id", "host", "text_hash").agg(F.sum("words").alias("lost_words"), F.collect_set("hash").alias("lost_hashes"))


def judge_quality(docs: DataFrame, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE, enough: int = ENOUGH_DOCS, max_lost: float = MAX_LOST) -> DataFrame:
    """Figures and verdict of each row of ``docs`` (``doc_id, host, text``).

    Returns ``doc_id, host, text_hash``, the base figures, ``base_failed``,
    ``kept``, ``lost_words`` and ``lost_hashes`` (null: none); one row for each
    input row, none for an empty table. Null and empty texts have no words and
    fail the base rules; a null host is a value like any other, rows without id
    are told apart by their texts; repeated rows get the same verdict and count
    as one document; texts and lines of any length count whole; other columns
    are ignored. The text is read once; afterwards only hashes of lines move.
    """
    bound_batches(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long"), F.col("host").cast("string"), F.col("text").cast("string"))
    stats = materialise(line_stats(slim), "line-stats")
    frequent = materialise(frequent_lines(stats, min_docs, min_share, enough), "frequent-lines")
    lost = lost_lines(stats, frequent).alias("l")
    s = stats.drop("lines").alias("s")
    on = F.col("s.doc_id").eqNullSafe(F.col("l.doc_id")) & F.col("s.host").eqNullSafe(F.col("l.host")) & (F.col("s.text_hash") == F.col("l.text_hash"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    lost_words = F.coalesce("lost_words", F.lit(0)).cast("long")
    return s.join(lost, on, "left").select(
        "s.*", failed.alias("base_failed"), (~failed & (lost_words <= max_lost * F.col("n_words"))).alias("kept"), lost_words.alias("lost_words"), "lost_hashes"
    )


def cleaned_text(text: bytes, lost: set[int]) -> bytes:
    return b"\n".join(x for x in text.split(b"\n") if not (own := x.split()) or line_hash(own) not in lost)


def clean_documents(docs: DataFrame, host_col: str = "source", **limits: float) -> DataFrame:
    """The documents that pass, without the removed lines; ``n_chars``, if there, follows the text.

    Same columns as ``docs``, which has ``doc_id``, ``text`` and ``host_col``.
    """
    names = docs.columns
    held = own_columns(docs, ["text_hash", "lost_hashes", "host"])
    order = held.columns
    back = dict(zip(held.columns, names, strict=True))
    host = held.columns[names.index(host_col)]
    verdict = judge_quality(held.select("doc_id", F.col(host).alias("host"), "text"), **limits)
    keys = verdict.where("kept").select("doc_id", "host", "text_hash", "lost_hashes").groupBy("doc_id", "host", "text_hash").agg(F.first("lost_hashes").alias("lost_hashes")).alias("k")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = byte_values(batch.column(batch.schema.get_field_index("text")))
            yield batch.append_column("text_hash", pa.array([xxhash.xxh3_64_intdigest(x) - (1 << 63) for x in data], pa.int64()))

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            lost = batch.column(batch.schema.get_field_index("lost_hashes")).to_pylist()
            text = batch.column(at)
            if any(lost):
                text = pa.array([cleaned_text(x, set(y)).decode("utf-8", "replace") if y else x.decode("utf-8", "replace") for x, y in zip(byte_values(text), lost, strict=True)], text.type)
            columns = {n: text if i == at else batch.column(i) for i, n in enumerate(batch.schema.names)}
            if "n_chars" in columns:
                columns["n_chars"] = pc.utf8_length(text).cast(pa.int64())
            yield pa.RecordBatch.from_pydict({n: columns[n] for n in order})

    if "n_chars" in held.columns:
        held = held.withColumn("n_chars", F.col("n_chars").cast("long"))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema.fields)
    d = held.mapInArrow(hashed, f"{ddl}, text_hash long").alias("d")
    on = F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")) & F.col(f"d.`{host}`").eqNullSafe(F.col("k.host")) & (F.col("d.text_hash") == F.col("k.text_hash"))
    met = d.join(keys, on).select(*[F.col(f"d.`{n}`") for n in held.columns], "k.lost_hashes")
    return met.mapInArrow(strip, ddl).toDF(*[back[n] for n in held.columns])
