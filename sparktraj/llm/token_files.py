"""Token-id files: flat unsigned integer files plus 64-bit document offsets, memory-mapped on reading.

The documents are dealt out by ranges of their id, so a partition's files follow those of the partitions before it, and a
partition's first token stands at the prefix sum of the earlier partitions' sizes.  A partition ``p`` writes

* ``ids-p-<attempt>.bin``: all ids in document order, little-endian, 16 bits each where the vocabulary allows, else 32;
* ``offsets-p-<attempt>.bin``: n + 1 little-endian unsigned 64-bit offsets into the former, in ids;
* ``docs-p-<attempt>.arrow``: the document ids, an Arrow file.

Each attempt of a task has files of its own and only the committed attempt's names get into the manifest, a Parquet table, so
a lost executor or a second copy of a task does no harm.

Defined results: a null text is empty and has the end id only; null ids come first; rows with one id stay apart, ordered by
the text's hash; an empty table gives an empty manifest; only the id and text columns are read.
"""

from __future__ import annotations

import functools
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktraj.llm.chunks import WORDS, ChunkEncoder, by_library
from sparktraj.llm.common import CHUNKED_BYTES, arrow_map, docs_of, id_type, new_path, read, shared_fs, slices

MANIFEST = "part int, ids string, offsets string, docs string, width int, n_docs long, n_ids long"


@functools.cache
def _encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(WORDS, by_library(path, lowered=True))


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)


@dataclass(frozen=True)
class TokenFiles:
    """What ``write_token_files`` has written: the folder, and one row per partition in ``manifest``, with ``base`` its first token."""

    folder: str
    manifest: DataFrame


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text") -> TokenFiles:
    """Encodes each text, appends ``end_id`` (None: nothing) and writes the files, in ascending order of ids."""
    spark = docs.sparkSession
    folder = new_path(spark, "token-ids")
    shared = shared_fs(folder)
    shared[0].create_dir(shared[1], recursive=True)
    width = 2 if max(vocabulary_size(tokenizer) - 1, end_id or 0) < 1 << 16 else 4
    end = np.array([] if end_id is None else [end_id], "<u4")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        names = [f"ids-{part:06d}-{attempt}.bin", f"offsets-{part:06d}-{attempt}.bin", f"docs-{part:06d}-{attempt}.arrow"]
        first = next(rows := slices(batches, most=CHUNKED_BYTES), None)
        if first is None:
            return
        fs, at = shared_fs(folder)
        encode, n_docs, n_ids = _encoder(tokenizer), 0, 0
        with fs.open_output_stream(f"{at}/{names[0]}") as ids_to, fs.open_output_stream(f"{at}/{names[1]}") as offsets_to, fs.open_output_stream(f"{at}/{names[2]}") as docs_to:
            offsets_to.write(np.zeros(1, "<u8"))
            with pa.ipc.new_file(docs_to, pa.schema([("doc_id", first.column("doc_id").type)])) as table:
                for b in (x for xs in ([first], rows) for x in xs):
                    ids = [np.concatenate([x, end]) for x in encode(b.column("text"))]
                    ends = np.cumsum([len(x) for x in ids], dtype="<u8") + np.uint64(n_ids)
                    ids_to.write(np.concatenate(ids).astype(f"<u{width}"))
                    offsets_to.write(ends)
                    table.write_batch(pa.record_batch({"doc_id": b.column("doc_id")}))
                    n_docs, n_ids = n_docs + len(b), int(ends[-1])
        yield pa.record_batch([pa.array([x], t) for x, t in zip((part, *names, width, n_docs, n_ids), (pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()))], names=["part", "ids", "offsets", "docs", "width", "n_docs", "n_ids"])

    d = docs_of(docs, id_col, text_col)
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    ordered = d.repartitionByRange("doc_id", key).sortWithinPartitions("doc_id", key)
    arrow_map(ordered, write, MANIFEST).write.parquet(f"{folder}/manifest")
    return TokenFiles(folder, based(spark, f"{folder}/manifest"))


def based(spark: SparkSession, path: str) -> DataFrame:
    """The manifest with each partition's base.  It has a row per partition of the writing job, so its prefix sum is taken on the driver."""
    rows, base, out = spark.read.schema(MANIFEST).parquet(path).orderBy("part").collect(), 0, []
    for r in rows:
        out.append((*r, base))
        base += r.n_ids
    return spark.createDataFrame(out, f"{MANIFEST}, base long").repartitionByRange(max(1, len(out)), "part")


def read_token_files(files: TokenFiles, doc_type: str = "bigint") -> DataFrame:
    """One row per document from the memory-mapped files: doc_id, start, n_tokens, ids_crc32 (of the ids as 32-bit integers)."""
    folder = files.folder

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = shared_fs(folder)
        for b in batches:
            for r in b.to_pylist():
                ids = np.frombuffer(fs.open_input_file(f"{at}/{r['ids']}").read_buffer(), f"<u{r['width']}")
                cut = np.frombuffer(fs.open_input_file(f"{at}/{r['offsets']}").read_buffer(), "<u8").astype(np.int64)
                names = pa.ipc.open_file(fs.open_input_file(f"{at}/{r['docs']}")).read_all()["doc_id"]
                edges = cut.tolist()
                crc = [zlib.crc32(ids[x:y].astype("<u4")) for x, y in zip(edges[:-1], edges[1:])]
                out = pa.table({"doc_id": names, "start": r["base"] + cut[:-1], "n_tokens": np.diff(cut), "ids_crc32": pa.array(crc, pa.int64())})
                yield from out.combine_chunks().to_batches(max_chunksize=10_000)

    return arrow_map(files.manifest, scan, f"doc_id {doc_type}, start long, n_tokens long, ids_crc32 long")


def op4_token_files(spark, sf_dir):
    import public_tokenizers

    docs = read(spark, sf_dir, "documents")
    return read_token_files(write_token_files(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2), id_type(docs))


QUERIES = {"op4_token_files": op4_token_files}
ORACLES = {}
