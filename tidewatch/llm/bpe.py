"""Byte-level BPE by dynamic programming over prefixes.

For every prefix of a piece of text the last token of its encoding is unique. Walking
the piece from left to right, an automaton gives the tokens that end at each place; the
one that may stand after the last token of the rest is kept. Following these tokens from
the end back to the start gives the encoding. No merge is ever replayed.

Two tokens may stand side by side if no merge crosses the seam between them. A merge of
the tokens a and b crosses it if a is on the right edge of the left token's merge tree,
b on the left edge of the right one's, and the merge comes before both are used up.

A null text is the empty text, which has no ids. Texts of any length are encoded whole.
"""

from __future__ import annotations

import json
import re
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import pre_tokenizers

from tidewatch.llm.texts import add_result, bound_batches, fresh
from tidewatch.session import with_tasks

with_tasks(__name__)

# Fixed value: the pattern by which byte-level vocabularies cut text into pieces.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Below this code point all Unicode versions agree on letters, digits and spaces. Texts with
# later characters are cut by the tokenizer library, whose version the ids must follow.
SETTLED = "՘"
# Pieces up to this size are remembered, in two generations of this many, and so many tested pairs.
KEPT_PIECE, KEPT_PIECES, KEPT_PAIRS = 64, 150_000, 300_000
NEVER = 1 << 60
# A pair of ids as one number.
PAIR = 32


def byte_signs() -> dict[str, int]:
    """The printable sign for each byte: itself where it is printable, else the next from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def settled_pattern() -> re.Pattern:
    """The same pattern for texts without later characters, whose classes are spelled out."""
    signs = [chr(c) for c in range(ord(SETTLED))]

    def spelled(kind: str) -> str:
        inside = [regex.match(kind, s) is not None for s in signs] + [False]
        edges = [i for i in range(len(inside)) if inside[i] != (i > 0 and inside[i - 1])]
        return "".join(f"\\u{lo:04x}-\\u{hi - 1:04x}" for lo, hi in zip(edges[::2], edges[1::2]))

    letter, number, space = spelled(r"\p{L}"), spelled(r"\p{N}"), spelled(r"\s")
    return re.compile(PIECE.replace(r"\p{L}+", f"[{letter}]+").replace(r"\p{N}+", f"[{number}]+")
                      .replace(r"[^\s\p{L}\p{N}]+", f"[^{space}{letter}{number}]+")
                      .replace(r"\s+(?!\S)|\s+", f"[{space}]+(?![^{space}])|[{space}]+"))


class Vocabulary:
    """Tokens as bytes by id, merges in order, and special tokens, of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        signs, ids = byte_signs(), content["model"]["vocab"]
        self.tokens: dict[int, bytes] = {i: bytes(signs[c] for c in t) for t, i in ids.items()}
        merges = [m if isinstance(m, list) else m.split(" ") for m in content["model"]["merges"]]
        self.merges = [(ids[a], ids[b], ids[a + b]) for a, b in merges]
        self.special = {t["content"]: t["id"] for t in content["added_tokens"]}
        self.tokens |= {i: t.encode() for t, i in self.special.items()}


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        special = set(vocabulary.special.values())
        made = {t for _, _, t in vocabulary.merges}
        self.rank = {t: -1 for t, raw in vocabulary.tokens.items() if len(raw) == 1}
        self.merge: dict[int, int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        for rank, (a, b, token) in enumerate(vocabulary.merges):
            self.merge.setdefault(a << PAIR | b, rank)
            self.halves.setdefault(token, (a, b))
            self.rank.setdefault(token, rank)
        self.automaton = ahocorasick.Automaton()
        for token, raw in vocabulary.tokens.items():
            if token not in special and (len(raw) == 1 or token in made):
                self.automaton.add_word(raw.decode("latin-1"), (token, len(raw)))
        self.automaton.make_automaton()
        # Plain tables: an encoder must hold no cycle, so that it goes when its task ends.
        self.pairs: dict[int, bool] = {}
        self.edges: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def edge(self, top: int, side: int) -> list[tuple[int, int]]:
        """(token, rank of the merge that uses it up) down one edge of a token's merge tree."""
        if (top, side) in self.edges:
            return self.edges[top, side]
        out, token, until = [], top, NEVER
        while True:
            out.append((token, until))
            if token not in self.halves:
                break
            until = self.rank[token]
            token = self.halves[token][side]
        self.edges[top, side] = out
        return out

    def apart(self, left: int, right: int) -> bool:
        """True if no merge crosses the seam of two tokens."""
        # Of equal merges the leftmost is made first.
        merges, rights = self.merge, self.edge(right, 0)
        for a, a_until in self.edge(left, 1):
            a <<= PAIR
            for b, b_until in rights:
                rank = merges.get(a | b)
                if rank is not None and rank < a_until and rank <= b_until:
                    return False
        return True

    def piece(self, raw: bytes) -> array:
        last, size, pairs = [-1] * (len(raw) + 1), [0] * (len(raw) + 1), self.pairs
        for at, (token, length) in self.automaton.iter(raw.decode("latin-1")):
            at += 1
            if last[at] >= 0:
                continue
            before = at - length
            if before:
                left = last[before]
                if left < 0:
                    continue
                pair = left << PAIR | token
                fits = pairs.get(pair)
                if fits is None:
                    if len(pairs) >= KEPT_PAIRS:
                        pairs.clear()
                    fits = pairs[pair] = self.apart(left, token)
                if not fits:
                    continue
            last[at], size[at] = token, length
        out, at = array("i"), len(raw)
        while at:
            out.append(last[at])
            at -= size[at]
        out.reverse()
        return out


class Pieces(dict):
    """Piece of text to its ids as packed int32, worked out on first sight.

    When it is full it becomes the older of two generations, from which pieces that come again
    are taken over; what did not come again meanwhile is forgotten."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder, self.older = encoder, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = self.encoder.piece(piece.encode()).tobytes()
        if len(piece) <= KEPT_PIECE:
            if len(self) >= KEPT_PIECES:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


def packed_encoder(vocabulary: Vocabulary):
    """A function from a text to its ids as packed int32."""
    known = Pieces(Encoder(vocabulary))
    cut, later = settled_pattern(), re.compile(f"[{SETTLED}-\U0010ffff]")
    library = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    special = vocabulary.special
    split = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None

    def plain(text: str) -> bytes:
        if later.search(text):
            found = [text[a:b] for _, (a, b) in library.pre_tokenize_str(text)]
        else:
            found = cut.findall(text)
        return b"".join(map(known.__getitem__, found))

    def encode(text: str) -> bytes:
        if split is None or not split.search(text):
            return plain(text)
        parts = split.split(text)
        return b"".join(np.int32(special[p]).tobytes() if i % 2 else plain(p) for i, p in enumerate(parts))

    return encode


def _lists(packed: list[bytes]) -> pa.Array:
    offsets = np.cumsum([0, *[len(p) // 4 for p in packed]], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), np.int32)))


def text_decoder(tokens: dict[int, bytes]):
    """A function from an array of ids to their text; bytes that are not UTF-8 become U+FFFD."""
    table = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
    return lambda ids: b"".join(map(table.__getitem__, ids.tolist())).decode("utf-8", "replace")


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """Append the token ids of each text as an array column and, with ``decoded``, a column of that name
    with the text that the ids decode to, as :func:`decode` gives it. An own column of such a name stays;
    the new one has an underscore before its name then.

    Two Python steps in a row run in two workers for each task at a time, and both stay in memory;
    with ``decoded`` it is one step and one worker."""
    vocabulary = Vocabulary(path)
    name, ids = fresh(docs, "encoded"), fresh(docs, ids)
    fields = [T.StructField("ids", T.ArrayType(T.IntegerType(), False))]
    if decoded is not None:
        fields.append(T.StructField("decoded", T.StringType()))

    def start():
        encoder = packed_encoder(vocabulary)
        back = None if decoded is None else text_decoder(vocabulary.tokens)

        def compute(texts):
            packed = [encoder(t.decode()) if t else b"" for t in texts]
            if back is None:
                return [_lists(packed)]
            return [_lists(packed), pa.array([back(np.frombuffer(p, np.int32)) for p in packed], pa.string())]

        return compute

    found = add_result(docs, text, T.StructType(fields), name, start).withColumn(ids, F.col(name)["ids"])
    if decoded is not None:
        found = found.withColumn(fresh(docs.withColumn(ids, F.lit(0)), decoded), F.col(name)["decoded"])
    return found.drop(name)


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Append the text of each array of ids; bytes that are not UTF-8 become U+FFFD. An own column
    of that name stays; the new one has an underscore before its name then."""
    bound_batches(df)
    text = fresh(df, text)
    tokens = Vocabulary(path).tokens
    out = T.StructType([*df.schema.fields, T.StructField(text, T.StringType())])
    at = df.columns.index(ids)

    def run(batches):
        back = text_decoder(tokens)
        for batch in batches:
            texts = [back(cell.values.to_numpy()) if cell.is_valid else None for cell in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())],
                                             names=[*batch.schema.names, text])

    return df.mapInArrow(run, out)


def round_trip(docs: DataFrame, path: str, keep_ids: bool = False) -> DataFrame:
    """A row per document: number of tokens, digests of the ids and of the text they decode
    to, and the ids if asked for."""
    both = encode(docs.select("doc_id", "text"), path, decoded="decoded").drop("text")
    joined = F.array_join("ids", ",")
    return both.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), *["ids"] * keep_ids,
                       F.sha2(joined.cast("binary"), 256).alias("ids_sha256"),
                       F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
