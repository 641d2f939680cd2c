"""Token-ID / binary output.

Documents are encoded with a public tokenizer, ids are replaced by their
frequency rank in the corpus (the most frequent id is 0) and written to binary
files in ascending document order.  Ranks use a byte-aligned variable-length
code: two bits of a separate *control* stream give each rank's length of 1 to 4
bytes, the *data* stream holds the little-endian bytes.  A reader looks the
control bytes up in a numpy table (256 x 4 lengths), so decoding has no
per-token Python step.

File layout (little-endian), a sequence of blocks::

    b"FRV1" | u32 n_docs | u64 n_tokens | u64 n_data_bytes
    i64 doc_id[n_docs] | u8 id_is_null[n_docs] | u32 n_tokens[n_docs]
    u8 control[ceil(n_tokens / 4)] | u8 data[n_data_bytes]

Each file is written under a name of its own; only files named by the committed
manifest table count, so a repeated or lost task leaves no wrong data.

Defined cases: a null text is empty (only the end id); null doc_ids come first;
repeated doc_ids are ordered by their encoded ids; an empty table gives no
files; other columns are ignored.
"""

from __future__ import annotations

import re
import struct
import uuid
from array import array

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BATCH_ROWS, Generations, crc32, file_system, materialize, scratch_dir, shuffle_partitions, text_or_empty
from .word_arrays import batches_of, byte_set, byte_slices, coded, split_words

MAGIC = b"FRV1"
HEADER = struct.Struct("<4sIQQ")
BLOCK_TOKENS = 1 << 20
CACHE_WORDS = 300_000
ENCODE_BYTES = 1 << 24  # text encoded at once; a longer text is encoded by itself
CHUNK_BYTE = byte_set(lambda b: b not in (10, 32))
LENGTHS = np.array([[1 + (c >> (2 * k) & 3) for k in range(4)] for c in range(256)], dtype=np.int64)


# --- tokenizer ---------------------------------------------------------------

class WordEncoder:
    """The tokenizer applied to the chunks of a batch of texts, with bounded caches.

    The tokenizer's normalizer maps white space to blanks and its
    pre-tokenizer drops them, so no piece crosses a blank or line feed: the ids
    of a text are those of its chunks in turn.  *Simple* chunks (printable ASCII
    without apostrophes, and Latin-1 letters) are put into lower case and split into
    pieces with numpy: runs of letters, single digits, runs of other signs.  Of
    other chunks those of Latin letters take a pattern in Python, and all others the
    library's own normalizer and pre-tokenizer.  Distinct pieces go through the
    library's model.  A text with the string of an added token goes through the
    library's ``encode`` as a whole.
    """

    # the ASCII form of the tokenizer file's split pattern (fixed value)
    PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
    PLAIN = re.compile(r"[!-~]*").fullmatch
    LATIN = re.compile("[!-~\u00a1-\u00ac\u00ae-\u012f\u0131-\u01c3\u01cd-\u01f0\u01f4-\u024f]*").fullmatch  # no title case, no letter that lower case makes two
    LATIN_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.latin_pieces = regex.compile(self.LATIN_PIECES).findall
        self.byte_letters = byte_letters()
        self.added = list(self.tokenizer.get_added_tokens_decoder().values())
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        self.pieces = Generations(CACHE_WORDS)  # piece -> ids as bytes
        self.chunks = Generations(CACHE_WORDS)  # chunk -> ids as bytes

    def _split(self, chunk: str) -> list[str]:
        if self.PLAIN(chunk):
            return self.PIECES.findall(chunk.lower())
        if self.LATIN(chunk):
            return [p.encode("utf-8").decode("latin-1").translate(self.byte_letters) for p in self.latin_pieces(chunk.lower())]
        text = self.tokenizer.normalizer.normalize_str(chunk)
        return [piece for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def _learn(self, items: list[bytes]) -> list[bytes]:
        """The ids of each distinct item: a piece of a simple chunk, or a whole other chunk."""
        simple = [SIMPLE(i) is not None for i in items]
        pieces = [i.decode("latin-1").translate(self.byte_letters) if s else None for i, s in zip(items, simple)]
        chunks = {i.decode("utf-8") for i, s in zip(items, simple) if not s}
        new = {chunk: self._split(chunk) for chunk in self.chunks.missing(chunks)}
        wanted = {piece for found in new.values() for piece in found}
        wanted.update(p for p in pieces if p is not None)
        tokenize, code = self.tokenizer.model.tokenize, "H" if self.width == 2 else "I"
        missing = self.pieces.missing(wanted)
        ids = self.pieces.now
        for p in missing:
            ids[p] = array(code, [t.id for t in tokenize(p)]).tobytes()
        known = self.chunks.now
        for chunk, found in new.items():
            known[chunk] = b"".join([ids[p] for p in found])
        return [ids[p] if p is not None else known[i.decode("utf-8")] for i, p in zip(items, pieces)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian bytes of ``self.dtype``."""
        import pyarrow as pa

        return [ids for part in self.encode_column(pa.array(texts, pa.string())) for ids in part]

    def encode_column(self, column):
        """Lists of the ids of the texts of an Arrow array, slice by slice.

        The pieces of a slice are coded by an Arrow dictionary; only distinct
        ones are looked up, and the ids of all are gathered by their codes.
        """
        for first, end in byte_slices(column, ENCODE_BYTES):
            part = column.slice(first, end - first)
            items, counts = pieces_of(*split_words(part, CHUNK_BYTE))
            codes, distinct = coded(items)
            ids = self._learn(distinct)
            flat = np.frombuffer(b"".join(ids), dtype=self.dtype)
            size = np.array([len(i) for i in ids], dtype=np.int64) // self.width
            starts = (np.cumsum(size) - size)[codes]
            size = size[codes]
            ends = np.cumsum(size)
            out = flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - ends + size, size)]
            edges = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])].tolist()
            found = [out[a:b].tobytes() for a, b in zip(edges, edges[1:])]
            for i in self._with_added_tokens(part):
                text = part[i].as_py()
                found[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()
            yield found

    def _with_added_tokens(self, column) -> list[int]:
        """Rows whose text holds the string of an added token, which the library cuts out before it splits."""
        import pyarrow.compute as pc

        rows: set[int] = set()
        for token in self.added:
            texts = column
            if token.normalized:  # looked for in the normalized text
                import pyarrow as pa

                texts = pa.array([self.tokenizer.normalizer.normalize_str(t) for t in column.to_pylist()], pa.string())
            rows.update(np.flatnonzero(pc.match_substring(texts, token.content).to_numpy(zero_copy_only=False)).tolist())
        return sorted(rows)


# classes of bytes in simple chunks: 0 letters (with the two bytes of a Latin-1 letter), 1 digits, 2 other signs
_KIND = np.array([1 if 48 <= b <= 57 else 0 if 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 2 for b in range(256)], dtype=np.uint8)
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
_PLAIN = byte_set(lambda b: 33 <= b <= 126 and b != 39)
SIMPLE = re.compile(rb"(?:[!-&(-~]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])*").fullmatch


def pieces_of(chunks, counts: np.ndarray):
    """(items, counts): the pieces of simple chunks in lower case and all other chunks whole, and how many each row has."""
    import pyarrow as pa

    n = len(chunks)
    offsets = np.frombuffer(chunks.buffers()[1], dtype=np.int64, count=n + 1)
    data = np.frombuffer(chunks.buffers()[2], dtype=np.uint8)
    if not n:
        return chunks, counts
    lead = data == 0xC3
    after = np.zeros(len(data), dtype=bool)
    after[1:] = lead[:-1]
    odd = ~_PLAIN[data] & ~lead & ~(after & (data >= 0x80) & (data != 0x97) & (data != 0xB7))
    simple = ~np.logical_or.reduceat(odd, offsets[:-1])
    inside = np.repeat(simple, np.diff(offsets))
    small = np.where(inside, _LOWER[data], data)
    small[inside & after & (data <= 0x9E)] += 32
    kind = _KIND[data]
    starts = np.zeros(len(data), dtype=bool)
    starts[1:] = inside[1:] & ((kind[1:] != kind[:-1]) | (kind[1:] == 1))
    starts[offsets[:-1]] = True
    each = np.add.reduceat(starts, offsets[:-1], dtype=np.int64)
    places = np.append(np.flatnonzero(starts), len(data))
    items = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(places) - 1, [None, pa.py_buffer(places.astype(np.int64).tobytes()), pa.py_buffer(small.tobytes())])
    edges = np.concatenate([[0], np.cumsum(each)])[np.concatenate([[0], np.cumsum(counts)])]
    return items, np.diff(edges)


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if it can be seen, else one from 256 on."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in seen]
    return {b: chr(256 + k) for k, b in enumerate(hidden)}


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder, with its cache, per Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def encode_documents(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian, ``end_id`` last) of each row."""

    def run(batches):
        import pyarrow as pa

        enc = encoder(tokenizer_path)
        end = np.array([end_id], dtype=enc.dtype).tobytes()
        # words repeat: the more text is coded at once, the fewer distinct words are looked up
        for held in batches_of(batches, 1, ENCODE_BYTES):
            keys, texts = (pa.concat_arrays([b.column(k) for b in held]) for k in (0, 1))
            ids = [b + end for part in enc.encode_column(texts) for b in part]
            for low in range(0, len(ids), BATCH_ROWS):
                part = ids[low:low + BATCH_ROWS]
                counts = [len(b) // enc.width for b in part]
                yield pa.RecordBatch.from_arrays([keys.slice(low, len(part)), pa.array(counts, pa.int64()), pa.array(part, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def frequency_ranks(encoded: DataFrame, width: int) -> np.ndarray:
    """Id of each rank, most frequent first, ties to the smaller id.

    Counts cover all documents; the driver gets one row per distinct id, at
    most the tokenizer's vocabulary.
    """
    dtype = np.dtype(f"<u{width}")

    def run(batches):
        import pyarrow as pa

        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            counts = np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=dtype))
            if len(counts) > len(total):
                total = np.pad(total, (0, len(counts) - len(total)))
            total[:len(counts)] += counts
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["id", "n"])

    counts = encoded.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    rows = sorted(((r.n, r.id) for r in counts.collect()), key=lambda r: (-r[0], r[1]))
    return np.array([r[1] for r in rows], dtype=np.uint32)


# --- code --------------------------------------------------------------------

def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) streams of unsigned 32-bit values."""
    values = np.ascontiguousarray(values, dtype="<u4")
    lengths = 1 + (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    codes = np.zeros(-(-len(values) // 4) * 4, dtype=np.uint8)
    codes[:len(values)] = lengths - 1
    control = codes.reshape(-1, 4) @ np.array([1, 4, 16, 64], dtype=np.uint8)
    data = values.view(np.uint8).reshape(-1, 4)[np.arange(4) < lengths[:, None]]
    return control.astype(np.uint8).tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` values of the two streams, by table lookup."""
    lengths = LENGTHS[np.frombuffer(control, dtype=np.uint8)].reshape(-1)[:n]
    at = np.cumsum(lengths) - lengths
    source = np.frombuffer(data + b"\0\0\0", dtype=np.uint8)
    out = source[at].astype(np.uint32)
    for k in range(1, 4):
        longer = np.flatnonzero(lengths > k)
        out[longer] |= source[at[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def write_block(doc_ids: list, ids: list[bytes], dtype: np.dtype, rank_of: np.ndarray) -> bytes:
    flat = np.frombuffer(b"".join(ids), dtype=dtype)
    control, data = pack(rank_of[flat])
    counts = np.array([len(b) // dtype.itemsize for b in ids], dtype="<u4")
    nulls = np.array([d is None for d in doc_ids], dtype=np.uint8)
    keys = np.array([d or 0 for d in doc_ids], dtype="<i8")
    return b"".join([HEADER.pack(MAGIC, len(doc_ids), len(flat), len(data)), keys.tobytes(), nulls.tobytes(), counts.tobytes(), control, data])


def read_blocks(stream, id_of: np.ndarray):
    """Per block: doc ids (None for null), token counts, ids."""
    while header := stream.read(HEADER.size):
        magic, n_docs, n_tokens, n_data = HEADER.unpack(header)
        if magic != MAGIC:
            raise ValueError("not a token file")
        keys = np.frombuffer(stream.read(8 * n_docs), dtype="<i8")
        nulls = np.frombuffer(stream.read(n_docs), dtype=np.uint8)
        counts = np.frombuffer(stream.read(4 * n_docs), dtype="<u4")
        control = stream.read(-(-n_tokens // 4))
        ranks = unpack(control, stream.read(n_data), n_tokens)
        yield [None if x else int(k) for k, x in zip(keys, nulls)], counts, id_of[ranks]


# --- files -------------------------------------------------------------------

def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int, out_dir: str | None = None,
                      id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, np.ndarray]:
    """Write ``docs`` as token files; the manifest (one row per file) and the id of each rank.

    Texts are encoded once where they are scanned; only the ids are dealt to
    ranges of (doc_id, hash of ids), so a doc_id with very many rows is split.
    """
    spark = docs.sparkSession
    out_dir = out_dir or scratch_dir(spark, "token-files")
    width = encoder(tokenizer_path).width
    dtype = np.dtype(f"<u{width}")
    encoded = materialize(encode_documents(docs, tokenizer_path, end_id, id_col, text_col), "token-ids")
    id_of = frequency_ranks(encoded, width)
    rank_of = np.zeros(int(id_of.max()) + 1 if len(id_of) else 1, dtype=np.uint32)
    rank_of[id_of] = np.arange(len(id_of), dtype=np.uint32)
    table = spark.sparkContext.broadcast(rank_of)  # at most the vocabulary: 4 bytes an id

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        files, folder = file_system(out_dir)
        files.create_dir(folder, recursive=True)
        name = f"part-{part:06d}-{uuid.uuid4().hex}.frv"
        n_docs = n_tokens = 0
        keys, ids, held = [], [], 0
        with files.open_output_stream(f"{folder}/{name}") as out:
            for batch in batches:
                for key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    keys.append(key)
                    ids.append(value)
                    held += len(value) // width
                    n_docs, n_tokens = n_docs + 1, n_tokens + len(value) // width
                    if held >= BLOCK_TOKENS:
                        out.write(write_block(keys, ids, dtype, table.value))
                        keys, ids, held = [], [], 0
            if keys:
                out.write(write_block(keys, ids, dtype, table.value))
        yield pa.RecordBatch.from_pylist([{"part": part, "file": name, "n_docs": n_docs, "n_tokens": n_tokens}] if n_docs else [],
                                         schema=pa.schema([("part", pa.int64()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    split = F.xxhash64("ids")
    dealt = (encoded.select("doc_id", "ids").repartitionByRange(shuffle_partitions(spark), "doc_id", split)
             .sortWithinPartitions("doc_id", split, "ids"))
    files = dealt.mapInArrow(run, "part long, file string, n_docs long, n_tokens long")
    return materialize(files.withColumn("folder", F.lit(out_dir)), "token-manifest"), id_of


def read_token_files(manifest: DataFrame, id_of: np.ndarray, digests: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and ids (or, with ``digests``, their ids_crc32) of every document.

    One task reads one file, block by block.  The driver sees one row per file
    to sum the tokens that come before it.
    """
    spark = manifest.sparkSession
    start, rows = 0, []
    for r in manifest.orderBy("part").collect():
        rows.append((r.folder, r.file, start))
        start += r.n_tokens
    table = spark.sparkContext.broadcast(id_of)  # at most the vocabulary
    last = ("ids_crc32", "long") if digests else ("ids", "array<long>")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for r in batch.to_pylist():
                files, folder = file_system(r["folder"])
                at = r["start"]
                with files.open_input_stream(f"{folder}/{r['file']}") as stream:
                    for keys, counts, ids in read_blocks(stream, table.value):
                        ends = np.cumsum(counts, dtype=np.int64)
                        starts = ends - counts
                        ids = ids.astype("<u4")
                        if digests:
                            value = pa.array([crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends)], pa.int64())
                        else:
                            value = pa.array([ids[a:b] for a, b in zip(starts, ends)], pa.list_(pa.int64()))
                        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(starts + at), pa.array(counts.astype(np.int64)), value], names=["doc_id", "start", "n_tokens", last[0]])
                        at += int(ends[-1])

    files = spark.createDataFrame(rows, "folder string, file string, start long").repartition(max(1, len(rows)))
    return files.mapInArrow(run, f"doc_id long, start long, n_tokens long, {last[0]} {last[1]}")
