"""SentencePiece encoding and decoding by a distinct-chunk table.

The library turns every space into a marker and puts one before the text. Where no piece
holds a marker after another character (checked when the model is loaded), no piece crosses
from one marked word into the next, so each distinct marked word need be segmented once.

1. Each input partition cuts the texts of a block into marked words and numbers the distinct
   ones. A document becomes the numbers of its words in order, its positions; the table of these
   is bucketed by block, so it need not move again. A block sends each owner of a share of all
   words the distinct words of that share, packed and compressed as one message.
2. An owner holds all blocks' words of its share. It segments and decodes each distinct one
   once and answers every block with ids in the order of its message. How a word decodes is sent
   only where that is not the word itself.
3. Each block meets its answers: by position, every document's numbers are replaced by ids.

A word costs a few bytes for each block that holds it, however often it stands there. Sent as
rows of their own, words and answers take over twice the input on disk.
"""

from __future__ import annotations

import re
import zlib
from array import array

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucketed, parts, str_texts, table

#: Characters of text that a block holds, but for its last document; a task holds one block.
BLOCK_CHARS = 32 << 20
#: Characters of all texts to one owner of words; a task holds the distinct words of one owner's share.
OWNER_CHARS = 16 << 20
MARK = "▁"
#: A marked word: a run of markers and what follows up to the next marker.
CHUNK = re.compile(f"{MARK}+[^{MARK}]*")


def chunks(text: str) -> list[str]:
    """The marked words of a text as the library sees it; an empty text has none."""
    return CHUNK.findall(MARK + text.replace(" ", MARK)) if text else []


class Segmenter:
    """The library with one model: ids and decoded texts of marked words."""

    def __init__(self, model: str):
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=model, num_threads=1)
        pieces = (self.lib.id_to_piece(i) for i in range(self.lib.get_piece_size()))
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece of this model crosses a marker: words can't be segmented one by one")
        self.mark = self.lib.piece_to_id(MARK)

    def ids(self, words: list[str]) -> list[list[int]]:
        # the library adds the first marker itself, but none to an empty text
        return [i if len(w) > 1 else [self.mark] for w, i in zip(words, self.lib.encode([w[1:] for w in words]), strict=True)]

    def texts(self, ids: list[list[int]]) -> list[str]:
        """What ids decode to inside a text: the library drops the first space of what it gets."""
        return self.lib.decode([[self.mark, *i] for i in ids])


def pack(words: list[str]) -> bytes:
    """Words as compressed bytes: their sizes in code points, then all of them side by side."""
    import pyarrow as pa

    sizes = np.array([len(words), *map(len, words)], np.int32).tobytes()
    raw = sizes + "".join(words).encode()
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd").compress(raw, asbytes=True)


def _raw(packed: bytes) -> bytes:
    import pyarrow as pa

    return pa.Codec("zstd").decompress(packed[8:], int.from_bytes(packed[:8], "little"), asbytes=True)


def unpack(packed: bytes) -> list[str]:
    raw = _raw(packed)
    n = int(np.frombuffer(raw, np.int32, 1)[0])
    text, ends = raw[4 * n + 4 :].decode(), np.cumsum(np.frombuffer(raw, np.int32, n, 4), dtype=np.int64).tolist()
    return [text[a:b] for a, b in zip([0, *ends], ends)]


def pack_lists(lists: list) -> bytes:
    """Lists of ids, compressed: how many, their lengths, then all ids."""
    import pyarrow as pa

    lengths = np.fromiter(map(len, lists), np.int32, len(lists))
    raw = b"".join((np.array([len(lists)], np.int32).tobytes(), lengths.tobytes(), np.fromiter((i for x in lists for i in x), np.int32, int(lengths.sum())).tobytes()))
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd").compress(raw, asbytes=True)


def unpack_lists(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the lists, and all ids."""
    raw = np.frombuffer(_raw(packed), np.int32)
    return raw[1 : 1 + raw[0]], raw[1 + raw[0] :]


def varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers below 2**28 as bytes of seven bits, lowest first, the last one below 128; and the bytes of each."""
    size = 1 + (values >= 1 << 7).astype(np.int8) + (values >= 1 << 14) + (values >= 1 << 21)
    starts = np.cumsum(size, dtype=np.int64) - size
    out = np.zeros(int(size.sum(dtype=np.int64)), np.uint8)
    for k in range(4):
        has = size > k
        out[starts[has] + k] = (values[has] >> 7 * k & 127) | np.where(size[has] > k + 1, 128, 0)
    return out, size


def read_varints(raw: np.ndarray) -> np.ndarray:
    if not len(raw):
        return np.zeros(0, np.int32)
    ends = np.flatnonzero(raw < 128)
    starts = np.concatenate([[0], ends[:-1] + 1])
    out = (raw[starts] & 127).astype(np.int32)
    for k in range(1, 4):
        has = ends - starts >= k
        out[has] |= (raw[starts[has] + k] & 127).astype(np.int32) << 7 * k
    return out


#: Words of a block that are put in place at once.
SLICE_WORDS = 1 << 19

#: A row is a document (words) or a block's message to an owner (numbers of its words in the block, and the words).
_SPLIT = "block long, doc_id long, words binary, owner int, numbers array<int>, packed binary"


def _split(block_chars: int, owners: int):
    def block_rows(block, ids, ends, flat, number):
        import pyarrow as pa

        i32, lists = pa.int32(), pa.list_(pa.int32())
        names = [x.split()[0] for x in _SPLIT.split(", ")]
        n = len(ids)
        # frequent words get the small numbers
        flat = np.frombuffer(flat, np.int32) if len(flat) else np.zeros(0, np.int32)
        rank = np.empty(len(number), np.int32)
        rank[np.argsort(-np.bincount(flat, minlength=len(number)), kind="stable")] = np.arange(len(number), dtype=np.int32)
        body, size = varints(rank[flat])
        cuts = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])[np.array([0, *ends], np.int64)].astype(np.int32)
        words = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(cuts), pa.py_buffer(body)])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), pa.array(ids, pa.int64()), words, pa.nulls(n, i32), pa.nulls(n, lists), pa.nulls(n, pa.binary())], names)
        del flat, body, size, words
        known = list(number)
        whose = np.fromiter((zlib.crc32(w.encode()) % owners for w in known), np.int32, len(known))
        order = np.argsort(whose, kind="stable").astype(np.int32)
        # words in order share their beginnings with their neighbours, and their first ids: both pack better
        mine = [sorted(m.tolist(), key=known.__getitem__) for m in np.split(order, np.flatnonzero(np.diff(whose[order])) + 1) if len(m)]
        m = len(mine)
        columns = [pa.array(np.full(m, block)), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.array([whose[x[0]] for x in mine], i32), pa.array([rank[x] for x in mine], lists), pa.array([pack([known[i] for i in x]) for x in mine], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names)

    def run(batches):
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        ids, ends, flat, number, held = [], [], array("i"), {}, 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), str_texts(batch.column(1)), strict=True):
                words = chunks(text)
                for w in dict.fromkeys(words):
                    if w not in number:
                        number[w] = len(number)
                flat.extend(map(number.__getitem__, words))
                ids.append(doc_id)
                ends.append(len(flat))
                held += len(text) + 8
                if held >= block_chars:
                    yield from block_rows(block, ids, ends, flat, number)
                    block, ids, ends, flat, number, held = block + 1, [], [], array("i"), {}, 0
        if ids:
            yield from block_rows(block, ids, ends, flat, number)

    return run


_ANSWER = "of long, owner int, ids binary, odd array<struct<at:int,text:string>>"


def _segmented(model: str):
    def run(key, sent):
        """Of one owner: each distinct word segmented and decoded once, and every block answered in its order."""
        import pyarrow as pa

        lib, ids, odd = Segmenter(model), {}, {}
        out = []
        for packed in sent.column("packed").to_pylist():
            words = unpack(packed)
            fresh = [w for w in words if w not in ids]
            found = lib.ids(fresh)
            ids.update(zip(fresh, (array("i", i) for i in found)))
            odd.update((w, t) for w, t in zip(fresh, lib.texts(found)) if t != w.replace(MARK, " "))
            out.append((pack_lists([ids[w] for w in words]), [{"at": i, "text": odd[w]} for i, w in enumerate(words) if w in odd] if odd else []))
        columns = [sent.column("block"), sent.column("owner"), pa.array([x for x, _ in out], pa.binary()), pa.array([x for _, x in out], pa.list_(pa.struct([("at", pa.int32()), ("text", pa.string())])))]
        return pa.table(columns, names=["of", "owner", "ids", "odd"])

    return run


def _joined(decode: bool):
    """One block's documents with its words' answers put in their places."""

    def run(key, mine, answers):
        import pyarrow as pa
        import pyarrow.compute as pc

        sent = mine.filter(pc.is_valid(mine.column("owner")))
        docs = mine.filter(pc.is_null(mine.column("owner")))
        told = {r["owner"]: r for r in answers.to_pylist()}
        ends = np.cumsum(pc.list_value_length(sent.column("numbers")).to_numpy())
        number = sent.column("numbers").combine_chunks().flatten().to_numpy()
        lists = [unpack_lists(told[o]["ids"]) for o in sent.column("owner").to_pylist()]
        # the answers laid end to end, and for each word of the block where its own begins
        flat = np.concatenate([np.zeros(0, np.int32), *(i for _, i in lists)])
        sizes = np.concatenate([np.zeros(0, np.int32), *(x for x, _ in lists)])
        start, size = np.zeros(len(number), np.int32), np.zeros(len(number), np.int32)
        start[number], size[number] = np.cumsum(sizes) - sizes, sizes
        del lists, sizes
        pieces = None
        if decode:
            read: list[str] = []
            for owner, packed in zip(sent.column("owner").to_pylist(), sent.column("packed").to_pylist(), strict=True):
                words = [w.replace(MARK, " ") for w in unpack(packed)]
                for x in told[owner]["odd"]:
                    words[x["at"]] = x["text"]
                read += words
            where = np.empty(len(number), np.int32)
            where[number] = np.arange(len(number), dtype=np.int32)
            pieces = pa.array(read, pa.string()).take(pa.array(where))
            del read, where
        raw = docs.column("words").cast(pa.binary()).combine_chunks()
        words = read_varints(np.concatenate([np.zeros(0, np.uint8), *(np.frombuffer(x, np.uint8) for x in raw.to_pylist())]))
        lengths = np.array([int((np.frombuffer(x, np.uint8) < 128).sum()) for x in raw.to_pylist()], np.int64)
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        del raw
        out, at = [], 0
        while at < len(docs):  # some documents at a time
            upto = max(at + 1, int(np.searchsorted(bounds, bounds[at] + SLICE_WORDS, side="right")) - 1)
            place, own = words[bounds[at] : bounds[upto]], bounds[at : upto + 1] - bounds[at]
            ends = np.cumsum(size[place], dtype=np.int64)
            ids = flat[np.repeat(start[place] - (ends - size[place]), size[place]) + np.arange(int(ends[-1]) if len(ends) else 0)]
            cuts = np.concatenate([[0], ends])[own].astype(np.int32)
            columns = [docs.column("doc_id").slice(at, upto - at).combine_chunks(), pa.ListArray.from_arrays(pa.array(cuts), pa.array(ids))]
            if decode:
                # the pieces of a text lie side by side, so the text is the bytes between its bounds
                read = pieces.take(pa.array(place))
                cuts = np.concatenate([[0], np.cumsum(pc.binary_length(read).to_numpy(zero_copy_only=False))])[own].astype(np.int32)
                text = pa.StringArray.from_buffers(upto - at, pa.py_buffer(cuts), read.buffers()[2] or pa.py_buffer(b""))
                columns.append(pc.utf8_slice_codeunits(text, 1))
            out.append(pa.table(columns, names=["doc_id", "ids", "decoded"][: len(columns)]))
            at = upto
        return pa.concat_tables(out)

    return run


def encode_decode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = True, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, ids (array<int>), decoded (string): encoded without begin or end ids, then decoded.

    Equal to the library's encode(text) and decode(ids); without `decode` there is no decoded
    column. A null or empty text has no ids and decodes to an empty text. Ids may be null or
    repeat; each row is encoded. An empty input gives no rows. Other columns of docs, whatever
    their names, are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    owners = max(parts(spark), size // OWNER_CHARS + 1)
    split = bucketed(rows.mapInArrow(_split(block_chars, owners), _SPLIT), "block", parts(spark), "split")
    messages = split.where("owner IS NOT NULL").select("block", "owner", "packed")
    answers = messages.groupBy("owner").applyInArrow(_segmented(model), _ANSWER)
    return split.groupBy("block").cogroup(answers.groupBy("of")).applyInArrow(_joined(decode), "doc_id long, ids array<int>" + ", decoded string" * decode)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op5_sentencepiece(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    out = encode_decode(table(spark, sf_dir, "documents"), model or default_model())
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
