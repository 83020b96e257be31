"""Byte-level BPE over documents with content-defined chunks that are encoded once."""

from __future__ import annotations

import hashlib
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext

from cohortry.llm.common import DataFrame, F, Marks, T, bit_map, materialise, per_slice, plain

# The split pattern of the vocabulary, as its library states it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

WINDOW = 16          # bytes the rolling hash sees
LEAST, MOST = 128, 4096  # bytes of a chunk
MASK = 0x1FF         # one place in 512 is a cut

_GEAR = np.random.default_rng(7).integers(0, 2**63, 65536, dtype=np.uint64)


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


class Codec:
    """Encodes and decodes with one vocabulary file.

    The exact library is slow on texts of ever new words, so pieces of plain Latin text go through the
    merge ranks of the same file; pieces with other characters go through the library itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json
        import tiktoken
        from tokenizers import Tokenizer
        self.exact = Tokenizer.from_file(path)
        self.exact.no_truncation()
        self.exact.no_padding()
        vocab = json.load(open(path, encoding="utf-8"))
        special = {t["content"]: t["id"] for t in vocab["added_tokens"]}
        back = _byte_letters()
        token = {i: bytes(back[c] for c in s) for s, i in vocab["model"]["vocab"].items() if s not in special}
        self.plain = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks={b: i for i, b in token.items()}, special_tokens=special)
        size = max(max(token), *special.values()) + 1
        self.bytes = [token.get(i, b"") for i in range(size)]
        for s, i in special.items():
            self.bytes[i] = s.encode()
        self.lens = np.array([len(b) for b in self.bytes], np.int64)
        self.names = [str(i) for i in range(size)]
        self.kind = "<u2" if size <= 65536 else "<u4"
        self.other = re.compile("[^\x00-\u024f]")

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        if self.other.search(text):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.plain.encode_to_numpy(text, allowed_special="all")

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        table = self.bytes
        return b"".join([table[i] for i in ids.tolist()])

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def digests(self, ids: np.ndarray) -> tuple[int, str, str]:
        names = self.names
        said = ",".join([names[i] for i in ids.tolist()]).encode()
        return len(ids), hashlib.sha256(said).hexdigest(), hashlib.sha256(self.decode(ids).encode()).hexdigest()


@lru_cache(maxsize=2)
def codec_of(path: str) -> Codec:
    """One codec per worker process."""
    return Codec(path)


def _byte_letters() -> dict[str, int]:
    """Printable letter of every byte in a byte-level vocabulary file: printable bytes stand for
    themselves, the rest follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


def cuts(data: bytes) -> list[int]:
    """Ends of the content-defined chunks of ``data``. A place is a cut where the rolling hash of the
    last bytes has its low bits zero; cuts move to the next blank within a few bytes, else to the next
    character, and chunks stay between ``LEAST`` and ``MOST`` bytes."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    b = np.frombuffer(data, np.uint8)
    pair = _GEAR[b[:-1].astype(np.int64) * 256 + b[1:]]
    run = np.cumsum(pair, dtype=np.uint64)
    h = run[WINDOW:] - run[:-WINDOW]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    at = np.flatnonzero(((h >> np.uint64(40)) & np.uint64(MASK)) == 0) + WINDOW + 2
    out, last = [], 0
    for c in [*at.tolist(), n]:
        while c - last > MOST:
            last = _settle(data, last + MOST)
            out.append(last)
        if c - last >= LEAST:
            c = _settle(data, c)
            if c - last >= LEAST:
                out.append(c)
                last = c
    if last < n:
        out.append(n)
    return out


def _settle(data: bytes, c: int) -> int:
    for p in range(c, min(c + 24, len(data))):
        if data[p] == 32:
            return p
    while c < len(data) and data[c] & 0xC0 == 0x80:
        c += 1
    return c


_EDGE = re.compile(rb"[\x21-\x7e](?=[ \t\r\n])")


def _firm(data: bytes, p: int) -> bool:
    """Whether a pretoken ends at ``p`` whatever stands around: a blank after a visible ASCII character.
    No alternative of the split pattern has a blank after something else."""
    return p in (0, len(data)) or (data[p] in b" \t\r\n" and 0x21 <= data[p - 1] <= 0x7E)


def repair(codec: Codec, parts: list[np.ndarray]) -> np.ndarray:
    """Ids of the joined text from the ids of its chunks.

    Around every joint the text between the nearest firm places on both sides is encoded again; the
    window grows until both ends are token ends of the chunks as well, so the new ids agree with what
    they are put between. A joint on a firm place needs nothing.
    """
    ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    if len(parts) < 2:
        return ids
    ends = np.concatenate([[0], np.cumsum(codec.lens[ids])])
    joints = np.cumsum([int(codec.lens[p].sum()) for p in parts])[:-1].tolist()
    data = codec.decode_bytes(ids)
    n, out, done = len(data), [], 0
    on = lambda p: ends[np.searchsorted(ends, p)] == p
    reach = 0  # end of the last window, in bytes
    for j in joints:
        if j < reach or _firm(data, j):
            continue
        left = j
        while left > 0 and not (_firm(data, left) and on(left)):
            left = _before(data, left)
        right = j
        while right < n and not (_firm(data, right) and on(right)):
            right = _after(data, right)
        left = max(left, reach)
        a, b = int(np.searchsorted(ends, left)), int(np.searchsorted(ends, right, "left"))
        out += [ids[done:a], codec.encode(data[left:right].decode("utf-8"))]
        done, reach = b, right
    return np.concatenate([*out, ids[done:]])


def _before(data: bytes, p: int) -> int:
    """The firm place before ``p``, or 0."""
    step = 64
    while True:
        low = max(0, p - step)
        found = None
        for m in _EDGE.finditer(data, low, p):
            if m.end() < p:
                found = m.end()
        if found is not None or low == 0:
            return found or 0
        step *= 4


def _after(data: bytes, p: int) -> int:
    m = _EDGE.search(data, p)
    return m.end() if m else len(data)


def _chunk_keys(data: bytes, ends: list[int]) -> list[bytes]:
    return [xxhash.xxh3_128_digest(data[s:e]) for s, e in zip([0, *ends], ends)]


_PIECE = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("ids", T.BinaryType())])
_SCAN = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("row", T.LongType()), T.StructField("doc_id", T.LongType()),
    T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()),
    T.StructField("seq", T.LongType()), T.StructField("key", T.BinaryType()), T.StructField("ids", T.BinaryType()), T.StructField("chunk", T.StringType())])


def shared_marks(docs: DataFrame) -> Marks:
    """Marks of the chunks that occur more than once. A chunk marked by chance takes the longer way for
    nothing."""
    out = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def make():
        def work(part, texts):
            keys = b"".join(k for t in texts for d in [t.encode()] for k in _chunk_keys(d, cuts(d)))
            a = np.frombuffer(keys, np.int64).reshape(-1, 2)
            return [pa.array(a[:, 0]), pa.array(a[:, 1])]
        return work
    keys = per_slice(plain(docs, "text"), "text", out, make)
    return bit_map(keys.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), F.col("a"))


def encode_documents(docs: DataFrame, path: str | None = None, keep_ids: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids): ids as little-endian 32-bit numbers, one row
    per row of ``docs``; ``keep_ids=False`` leaves the ids out once they are digested.

    Texts are cut at content-defined places. What lies between two shared chunks is encoded where it is
    read; a shared chunk is sent once, encoded once, and its ids are joined to the documents that have
    it. Joints are repaired until they agree with the whole text's encoding. Null and empty texts have
    no tokens; special tokens in a text are recognised, as the library does by default; repeated rows
    give repeated results; an empty table gives no rows.
    """
    path = path or vocabulary_path()
    spark = docs.sparkSession
    marks = spark.sparkContext.broadcast(shared_marks(docs))

    def make():
        codec, held, task = codec_of(path), marks.value, TaskContext.get().partitionId()
        state = {"row": task << 36}

        def work(part, texts):
            rows, sent = [], set()
            for doc_id, text in zip(part.column(0).to_pylist(), texts):
                data = text.encode()
                ends = cuts(data)
                keys = _chunk_keys(data, ends)
                hit = held.have(np.frombuffer(b"".join(keys), np.int64)[::2]).tolist()
                state["row"] += 1
                row = state["row"]
                if not any(hit):
                    ids = codec.encode(text)
                    rows.append(("whole", row, doc_id, *codec.digests(ids), None, None, ids.astype("<u4").tobytes() if keep_ids else None, None))
                    continue
                start = seq = 0
                for k, (s, e) in enumerate(zip([0, *ends], ends)):
                    if not hit[k]:
                        if k + 1 == len(ends) or hit[k + 1]:
                            ids = codec.encode(data[start:e].decode())
                            rows.append(("run", row, doc_id, None, None, None, seq, None, ids.astype(codec.kind).tobytes(), None))
                            start, seq = e, seq + 1
                        continue
                    first = keys[k] not in sent
                    sent.add(keys[k])
                    rows.append(("chunk", row, doc_id, None, None, None, seq, keys[k], None, data[s:e].decode() if first else None))
                    start, seq = e, seq + 1
            return [list(c) for c in zip(*rows)] if rows else [[] for _ in _SCAN]
        return work
    scan = materialise(per_slice(plain(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")), "text", _SCAN, make), "bpe")
    whole = scan.where("kind = 'whole'").select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids")
    chunks = scan.where("kind = 'chunk' and chunk is not null").groupBy("key").agg(F.first("chunk").alias("chunk"))

    def encode_chunks():
        codec = codec_of(path)
        return lambda part, texts: [part.column(0), [codec.encode(t).astype(codec.kind).tobytes() for t in texts]]
    known = per_slice(chunks, "chunk", _PIECE, encode_chunks)
    uses = scan.where("kind = 'chunk'").select("row", "doc_id", "seq", "key").join(known, "key").select("row", "doc_id", "seq", "ids")
    pieces = scan.where("kind = 'run'").select("row", "doc_id", "seq", "ids").unionByName(uses)
    dealt = pieces.repartition("row").sortWithinPartitions("row", "seq")

    def assemble(batches):
        codec = codec_of(path)
        now, doc, held, made = None, None, [], []

        def close():
            ids = repair(codec, held)
            made.append((doc, *codec.digests(ids), ids.astype("<u4").tobytes() if keep_ids else None))
        for batch in batches:
            for row, doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist()):
                if row != now:
                    if now is not None:
                        close()
                    now, doc, held = row, doc_id, []
                held.append(np.frombuffer(ids, codec.kind).astype(np.uint32))
            yield _rows(made)
            made = []
        if now is not None:
            close()
            yield _rows(made)
    joined = dealt.mapInArrow(assemble, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary")
    return whole.unionByName(joined)


def _rows(made: list[tuple]) -> pa.RecordBatch:
    kinds = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("ids", pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], t) for i, (_, t) in enumerate(kinds)], names=[n for n, _ in kinds])


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) from the ids of :func:`encode_documents`."""
    path = path or vocabulary_path()

    def run(batches):
        codec = codec_of(path)
        for batch in batches:
            texts = [codec.decode(np.frombuffer(b, "<u4")) for b in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])
    return plain(encoded, "doc_id", "ids").mapInArrow(run, "doc_id long, text string")
