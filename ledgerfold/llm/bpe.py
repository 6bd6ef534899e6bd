"""Byte-pair encoding of whole texts by tree concatenation, and decoding.

A long text is halved until the parts are short, the parts are encoded in
parallel, and neighbours are joined pairwise: the surroundings of the join are
encoded again, in growing windows, until the result agrees with both sides at
the window's ends. Two facts make the joined encoding exact:

* The pattern that splits text before the merges never looks back, and always
  cuts where white space follows something else or a letter meets a digit. Words
  and signs between such cuts are encoded once each, however often they occur.
* Within one piece of that pattern, a sequence of tokens is the encoding if each
  two neighbours are the encoding of their own bytes. Inside a side and inside
  the window they are; at a window's end they are if the token there is the same.
"""

from __future__ import annotations

import os
import re
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import KEY, named, released, slices, with_row_key
from .queries import QUERIES, table

VOCABULARY = "byte_bpe_50k.json"
# Parameters: code points of the longest part, and of the first window on each side.
LEAF = 32_768
WINDOW = 64
# Bytes or code points split at once, pieces kept in memory, new pieces encoded as one text.
CHUNK = 1_000_000
CACHED_PIECES = 150_000
JOINED = 2_000
# Letters that all versions of Unicode call so; what may follow them, and what may stand alone;
# text between two sure cuts, in small and in large pieces; sure cuts; code points around a place inside one piece.
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
SMALL_PIECE = re.compile(
    rf"\s*(?:[{LETTERS}]++(?=[ -@\[-`{{-~\n]|\Z)|[!-&(-@\[-`{{-~]++(?=[ \nA-Za-z]|\Z)|\S+(?:(?![ \n])\s+\S+)*)|\s+")
PIECE = re.compile(r"\s*\S+(?:(?![ \n])\s+\S+)*|\s+")
CUT = re.compile(r"(?<=\S)(?=[ \n])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")
AROUND = 4


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


class Encoder:
    """The tokenizer of a file, with each distinct piece of text encoded once."""

    def __init__(self, path: str, cached_pieces: int = CACHED_PIECES, chunk: int = CHUNK):
        self.cached_pieces, self.chunk = cached_pieces, chunk
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        split = self.tokenizer.pre_tokenizer
        if self.tokenizer.normalizer or not isinstance(split, ByteLevel) or split.add_prefix_space or not split.use_regex:
            raise ValueError("only byte-level tokenizers that leave the text as it is can be joined exactly")
        added = self.tokenizer.get_added_tokens_decoder()
        self.sizes = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), np.int64)
        for token, at in self.tokenizer.get_vocab(with_added_tokens=True).items():
            # a byte of a token is one character there; an added token stands as it is
            self.sizes[at] = len(token.encode()) if at in added else len(token)
        self.added = [x.content for x in added.values()]
        self.window = max([WINDOW, *(len(x.content) + 2 * AROUND for x in added.values())])
        # known pieces: their numbers, ids one after the other, ends of these, and how often they were met
        self.places: dict[str, int] = {}
        self.ids, self.ends, self.met = [], [np.zeros(1, np.int64)], np.zeros(0, np.int64)

    def _forget(self):
        """Drop the pieces that were met only once."""
        often = self.met > 1
        ids, ends = self._flat()
        lengths = np.diff(ends)
        self.places = dict(zip((p for p, k in zip(self.places, often) if k), range(len(often))))
        self.ids = [ids[np.repeat(often, lengths)]]
        self.ends = [np.concatenate([[0], np.cumsum(lengths[often])])]
        self.met = np.ones(len(self.places), np.int64)

    def _flat(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.ids) == len(self.ends) == 1:
            return self.ids[0], self.ends[0]
        self.ids = [np.concatenate([np.zeros(0, np.uint32), *self.ids])]
        self.ends = [np.concatenate(self.ends)]
        return self.ids[0], self.ends[0]

    def whole(self, text: str) -> np.ndarray:
        return np.array(self._batch([text])[0].ids, np.uint32)

    def _add(self, pieces: list[str]) -> None:
        """Encode new pieces; those that begin at a sure cut and end before one go as one text."""
        fit, rest = [], []
        for piece in pieces:
            (fit if piece[0] in " \n" and not piece[-1].isspace() else rest).append(piece)
        groups = [fit[i:i + JOINED] for i in range(0, len(fit), JOINED)]
        for some, found in zip(groups, self._batch(["".join(g) for g in groups])):
            ids = np.array(found.ids, np.uint32)
            last = np.cumsum([len(p) if p.isascii() else len(p.encode("utf-8", "surrogatepass")) for p in some])
            self._keep(some, ids, np.searchsorted(np.cumsum(self.sizes[ids]), last) + 1)
        for i in range(0, len(rest), JOINED):
            some = rest[i:i + JOINED]
            each = [e.ids for e in self._batch(some)]
            lengths = np.fromiter(map(len, each), np.int64, len(each))
            self._keep(some, np.fromiter(chain.from_iterable(each), np.uint32), np.cumsum(lengths))

    def _batch(self, texts: list[str]):
        return self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)

    def _keep(self, pieces: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        first = len(self.places)
        self.places.update(zip(pieces, range(first, first + len(pieces))))
        self.ids.append(ids)
        self.ends.append(ends + self.ends[-1][-1])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        out, held, size = [], [], 0
        for text in texts:
            held.append(text)
            size += len(text)
            if size >= self.chunk:
                out += self._encode(held)
                held, size = [], 0
        return out + (self._encode(held) if held else [])

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        # an added token must stay in one piece
        split = [(PIECE if any(a in t for a in self.added) else SMALL_PIECE).findall(t) for t in texts]
        if len(self.places) > self.cached_pieces:
            self._forget()
        pieces = list(chain.from_iterable(split))
        at = np.fromiter(map(self.places.get, pieces, repeat(-1)), np.int64, len(pieces))
        unknown = np.flatnonzero(at < 0)
        if len(unknown):
            missing = [pieces[i] for i in unknown]
            new = list(dict.fromkeys(missing))
            self._add(new)
            at[unknown] = np.fromiter(map(self.places.__getitem__, missing), np.int64, len(missing))
            self.met = np.concatenate([self.met, np.zeros(len(new), np.int64)])
        self.met += np.bincount(at, minlength=len(self.met))
        ids, ends = self._flat()
        starts, lengths = ends[at], ends[at + 1] - ends[at]
        shift = np.cumsum(lengths) - lengths
        tokens = ids[np.repeat(starts - shift, lengths) + np.arange(lengths.sum())]
        counts = np.cumsum([0, *map(len, split)])
        bounds = np.concatenate([shift, [len(tokens)]])[counts]
        return [tokens[i:j] for i, j in zip(bounds, bounds[1:])]

    def _one_piece(self, text: str) -> bool:
        return len(text) == 2 * AROUND and len(self.tokenizer.pre_tokenizer.pre_tokenize_str(text)) == 1

    def _end(self, text: str, ids: np.ndarray, window: int, left: bool):
        """Where a window may end in a side: its code points, its tokens, and the token that must agree there.

        At a sure cut nothing needs to agree. None if there is no such place about `window` from the join.
        """
        if window >= len(text):
            return len(text), len(ids), None
        zone = text[-2 * window:] if left else text[:2 * window]
        near = ids[::-1][:8 * window] if left else ids[:8 * window]
        ends = np.cumsum(self.sizes[near])
        outer = lambda at: zone[at:] if left else zone[:at]  # noqa: E731  the window's part of the zone
        cuts = [m.start() for m in CUT.finditer(zone) if len(outer(m.start())) >= window]
        for at in reversed(cuts) if left else cuts:
            size = len(outer(at).encode("utf-8", "surrogatepass"))
            k = int(np.searchsorted(ends, size))
            if k < len(ends) and ends[k] == size:
                return len(outer(at)), k + 1, None
        data = zone.encode("utf-8", "surrogatepass")
        size = len((zone[-window:] if left else zone[:window]).encode("utf-8", "surrogatepass"))
        for k in range(int(np.searchsorted(ends, size)), len(ends)):
            if ends[k] >= len(data):
                return None
            edge = len(data) - ends[k] if left else ends[k]
            if data[edge] & 0xC0 != 0x80:  # at a character
                at = len(data[:edge].decode("utf-8", "surrogatepass"))
                if at >= AROUND and self._one_piece(zone[at - AROUND:at + AROUND]):
                    return len(outer(at)), k + 1, near[k]
        return None

    def join(self, left: tuple[str, np.ndarray], right: tuple[str, np.ndarray]) -> tuple[str, np.ndarray]:
        """Text and ids of two neighbours together."""
        (text, ids), (text2, ids2), window = left, right, self.window
        while True:
            a, b = self._end(text, ids, window, True), self._end(text2, ids2, window, False)
            window *= 2
            if a and b:
                middle = self.whole(text[len(text) - a[0]:] + text2[:b[0]])
                if len(middle) and a[2] in (None, middle[0]) and b[2] in (None, middle[-1]) or not text + text2:
                    return text + text2, np.concatenate([ids[:len(ids) - a[1]], middle, ids2[b[1]:]])

    def tree(self, parts: list[tuple[str, np.ndarray]]) -> np.ndarray:
        """The ids of the concatenated parts, joined pairwise, level by level."""
        while len(parts) > 1:
            parts = [self.join(*parts[i:i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0][1]

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.tokenizer.decode_batch(ids, skip_special_tokens=False)


def halves(text: str, leaf: int) -> list[str]:
    """The text, halved until no part is longer than `leaf`."""
    if len(text) <= leaf:
        return [text]
    return halves(text[:len(text) // 2], leaf) + halves(text[len(text) // 2:], leaf)


def _without(batch: pa.RecordBatch, gone: str, **added: pa.Array) -> pa.RecordBatch:
    """The batch with a column replaced by others."""
    kept = [n for n in batch.schema.names if n != gone]
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), *added.values()], [*kept, *added])


def _binary(ids: list[np.ndarray]) -> pa.Array:
    return pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())


def _encoded(encoder: Encoder, ids: list[np.ndarray], decoded: bool) -> dict[str, pa.Array]:
    """The columns that an encoded batch gets."""
    texts = {"decoded": pa.array(encoder.decode([x.tolist() for x in ids]), pa.string())} if decoded else {}
    return {"ids": _binary(ids), **texts}


def _encode_texts(path: str, decoded: bool = False, keep_text: bool = False):
    def run(batches):
        encoder = Encoder(path)
        for batch in batches:
            for some in slices(batch, "text", CHUNK):
                ids = encoder.encode(some.column("text").to_pylist())
                yield _without(some, "" if keep_text else "text", **_encoded(encoder, ids, decoded))

    return run


def _cut(leaf: int):
    def run(batches):
        for batch in batches:
            for some in slices(batch, "text", CHUNK):
                parts = [halves(t, leaf) for t in some.column("text").to_pylist()]
                rows = some.take(pa.array(np.repeat(np.arange(len(parts)), [*map(len, parts)])))
                yield _without(
                    rows, "text", place=pa.array([i for p in parts for i in range(len(p))], pa.int32()),
                    text=pa.array([*chain.from_iterable(parts)], pa.string()))

    return run


def _encode_parts(path: str, decoded: bool):
    def run(batches):
        encoder = Encoder(path)
        for batch in batches:
            for i in range(batch.num_rows):
                parts = batch.column("parts")[i].as_py()
                ids = encoder.tree([(p["text"], np.frombuffer(p["ids"], "<u4")) for p in parts])
                yield _without(batch.slice(i, 1), "parts", **_encoded(encoder, [ids], decoded))

    return run


def encode(
    docs: DataFrame, path: str, leaf: int = LEAF, decoded: bool = False, id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of `docs`: KEY, doc_id and ids (little-endian unsigned 32-bit integers).

    With `decoded`, the text that the ids decode to is another column, made by
    the same task.

    The ids are those the tokenizer of the file gives for the whole text; a null
    text is empty, and an empty text has no ids. Texts of up to `leaf` code
    points are encoded in the scan; of longer ones the parts are spread over all
    tasks, and a text's parts meet again in one row. Null and repeated ids don't
    matter. An empty table gives no rows. Other columns are ignored.
    """
    rows = with_row_key(docs).select(
        *KEY, named(id_col).alias("doc_id"), F.coalesce(named(text_col), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    head = f"{KEY[0]} long, {KEY[1]} long, doc_id {kind}"
    out = f"{head}, ids binary" + ", decoded string" * decoded
    short = rows.filter(F.length("text") <= leaf).mapInArrow(released(_encode_texts(path, decoded)), out)
    leaves = (
        rows.filter(F.length("text") > leaf).mapInArrow(released(_cut(leaf)), f"{head}, place int, text string")
        .repartition(*KEY, "place")
        .mapInArrow(released(_encode_texts(path, keep_text=True)), f"{head}, place int, text string, ids binary")
    )
    long = (
        leaves.groupBy(*KEY, "doc_id")
        .agg(F.sort_array(F.collect_list(F.struct("place", "text", "ids"))).alias("parts"))
        .mapInArrow(released(_encode_parts(path, decoded)), out)
    )
    return short.unionByName(long)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The rows of `encoded` with `text`, decoded from ids, in their place. Special tokens are kept; no ids give ''."""

    def run(batches):
        encoder = Encoder(path)
        for batch in batches:
            for some in slices(batch, "ids", CHUNK):
                ids = [np.frombuffer(x, "<u4").tolist() for x in some.column("ids").to_pylist()]
                yield _without(some, "ids", text=pa.array(encoder.decode(ids), pa.string()))

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema if f.name != "ids"]
    return encoded.mapInArrow(run, ", ".join([*fields, "text string"]))


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = encode(table(spark, sf_dir, "documents"), vocabulary_path(), decoded=True)
    return encoded.select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES["op2_bpe_round_trip"] = op2_bpe_round_trip
