"""SentencePiece byte-pair encoding through a last-token-of-each-prefix table, and decoding."""

from __future__ import annotations

import codecs
import functools
import hashlib
import re
from collections.abc import Iterator
from struct import pack

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from tidemark.llm.common import Memo, fields, read

SPACE = "▁"
NEVER = float("inf")
MODEL = "piece_bpe_32k.model"
ROWS = 200  # texts whose ids are held at once

codecs.register_error("each_byte", lambda e: ("�" * (e.end - e.start), e.end))


class PieceTable:
    """Encoder and decoder for a merge-type SentencePiece model without text normalisation.

    Byte-pair encoding has the property that each prefix of a text ends in one token only, whatever follows. So the
    table keeps, for each prefix, that last token: of the vocabulary's matches that end there (found by an
    Aho-Corasick automaton), it is the only one that can follow the last token of the prefix before it. Whether two
    tokens can be neighbours is tested by undoing their merges from the latest to the earliest and looking for a merge
    across the seam that would have come first. The ids are read from the table backwards.
    """

    def __init__(self, model: bytes):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        if sp.normalize("ﬁ  ①") != f"{SPACE}ﬁ{SPACE}{SPACE}①":
            raise ValueError("the model normalises texts; only models that keep them are supported")
        n = sp.vocab_size()
        self.begin, self.end, self.unknown = sp.bos_id(), sp.eos_id(), sp.unk_id()
        self.silent = {i for i in range(n) if sp.is_control(i)}
        self.byte_of = {i: int(sp.id_to_piece(i)[1:-1], 16) for i in range(n) if sp.is_byte(i)}
        self.byte_id = {b: i for i, b in self.byte_of.items()}
        special = self.silent | set(self.byte_of) | {self.unknown}
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        plain = {self.pieces[i]: i for i in range(n) if i not in special and not sp.is_unused(i)}
        self.known = {p for p in plain if len(p) == 1}
        plain = {p: i for p, i in plain.items() if set(p) <= self.known}
        self.spans_space = any(re.search(f"[^{SPACE}]{SPACE}", p) for p in plain)
        #: Pairs of characters that some piece has side by side; no token crosses another pair.
        self.pairs = {p[i : i + 2] for p in plain for i in range(len(p) - 1)}

        # The merge that makes each piece, and its time: sentencepiece merges the best score first, then the leftmost.
        score = {p: -sp.get_score(i) for p, i in plain.items() if len(p) > 1}
        self.halves: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.time = {i: -NEVER for p, i in plain.items() if len(p) == 1}
        self.matches = ahocorasick.Automaton()
        for p, i in plain.items():
            if len(p) > 1:
                parts = self._merge(p, score)
                if parts is None:  # its own characters never merge to it, so it never occurs
                    continue
                self.halves[i] = (plain[parts[0]], plain[parts[1]])
                self.merged[self.halves[i]] = i
                self.time[i] = score[p]
            self.matches.add_word(p, (i, len(p), i << 32))
        self.matches.make_automaton()

        self._fits = Memo(self._can_follow, 400_000)
        self.with_space = Memo(lambda w: self._ids(SPACE + w))
        self.without_space = Memo(self._ids)
        self._surface = [self._bytes(i) for i in range(n)]

    @staticmethod
    def _merge(piece: str, score: dict[str, float]) -> tuple[str, str] | None:
        """The last two symbols that plain merging joins to the piece, or None."""
        parts = list(piece)
        while len(parts) > 1:
            at = min(range(len(parts) - 1), key=lambda k: (score.get(parts[k] + parts[k + 1], NEVER), k))
            if parts[at] + parts[at + 1] not in score:
                return None
            if len(parts) == 2:
                return parts[0], parts[1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return None

    def _can_follow(self, pair: int) -> bool:
        """Whether plain merging can leave the two tokens side by side.

        Going back in time, (left, right) are the symbols at the seam and `until` is when the pair ended: a merge of
        the two before that would have happened. Of equal times the one further left comes first: a merge at the seam
        precedes one inside the right token and follows one inside the left token.
        """
        right, left = pair >> 32, pair & 0xFFFFFFFF
        until, seam_first = NEVER, False
        while True:
            across = self.merged.get((left, right))
            if across is not None and (self.time[across] < until or seam_first and self.time[across] == until):
                return False
            a, b = self.time[left], self.time[right]
            if a == b == -NEVER:
                return True
            if b >= a:
                right, until, seam_first = self.halves[right][0], b, True
            else:
                left, until, seam_first = self.halves[left][1], a, False

    def _ids(self, chunk: str) -> bytes:
        """Ids of a run of characters, as little-endian unsigned 32-bit integers."""
        if len(chunk) > 2 and chunk[-1] in ",.;:!?" and chunk[-2:] not in self.pairs and len(chunk) <= 40:
            head = self.with_space[chunk[1:-1]] if chunk[0] == SPACE else self.without_space[chunk[:-1]]
            return head + self.without_space[chunk[-1]]
        out: list[bytes] = []
        at = 0
        if not self.known.issuperset(chunk):
            for i, c in enumerate(chunk):
                if c not in self.known:
                    out += [self._run(chunk[at:i]), self._outside(c)]
                    at = i + 1
        out.append(self._run(chunk[at:]))
        return b"".join(out)

    def _outside(self, char: str) -> bytes:
        """A character that is no piece: its bytes, or the unknown id."""
        raw = char.encode()
        ids = [self.byte_id[b] for b in raw] if self.byte_id else [self.unknown]
        return np.array(ids, dtype="<u4").tobytes()

    def _run(self, chunk: str) -> bytes:
        if not chunk:
            return b""
        n, fits = len(chunk), self._fits
        # last[k]: the last token of the prefix of k characters, which always exists as each character is a piece
        last, size, done = [0] * (n + 1), [0] * (n + 1), -1
        for end, (token, length, high) in self.matches.iter(chunk):
            if end != done:
                before = end + 1 - length
                if not before or fits[high | last[before]]:
                    last[end + 1], size[end + 1] = token, length
                    done = end
        fits.trim()
        ids, at = [], n
        while at:
            ids.append(last[at])
            at -= size[at]
        ids.reverse()
        return pack(f"<{len(ids)}I", *ids)

    def encode_bytes(self, text: str) -> bytes:
        """Ids between the begin and end id, as little-endian unsigned 32-bit integers."""
        out = [np.array([self.begin], "<u4").tobytes()]
        if text:
            out.append(self._body(text))
        out.append(np.array([self.end], "<u4").tobytes())
        return b"".join(out)

    def _body(self, text: str) -> bytes:
        out: list[bytes] = []
        put, spaced, bare = out.append, self.with_space, self.without_space
        if self.spans_space or SPACE in text:
            return self._run_long((SPACE + text).replace(" ", SPACE))
        lines = text.split("\n") if "\n" not in self.known else [text]
        newline = self._outside("\n") if len(lines) > 1 else b""
        for k, line in enumerate(lines):
            if k:
                put(newline)
            words = (line if k else " " + line).split(" ")
            if "" in words[1:] or max(map(len, words)) > 64:
                put(self._run_long((line if k else " " + line).replace(" ", SPACE)))
                continue
            if words[0]:
                put(bare[words[0]])
            out.extend(map(spaced.__getitem__, words[1:]))
        spaced.trim()
        bare.trim()
        return b"".join(out)

    def _run_long(self, text: str) -> bytes:
        """As _ids, for texts with repeated spaces or very long words: cut where a word begins, nothing kept."""
        if self.spans_space:
            return self._ids(text)
        out = []
        for m in re.finditer(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+", text):
            chunk = m[0]
            out.append(self.without_space[chunk] if len(chunk) <= 64 else self._ids(chunk))
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def _bytes(self, i: int) -> bytes:
        if i in self.silent:
            return b""
        if i in self.byte_of:
            return bytes([self.byte_of[i]])
        if i == self.unknown:
            return " ⁇ ".encode()
        return self.pieces[i].replace(SPACE, " ").encode()

    def decode(self, ids: list[int]) -> str:
        """The text of ids: control ids are silent, the space put before a text goes, stray bytes become U+FFFD."""
        raw = b"".join(map(self._surface.__getitem__, ids))
        for i in ids:
            if i not in self.silent:
                if self.pieces[i][:1] == SPACE:
                    raw = raw[1:]
                break
        return raw.decode("utf-8", "each_byte")


_load = functools.cache(PieceTable)


def table(path: str | None = None) -> PieceTable:
    """The table of a model file, built once per process."""
    with open(path or public_tokenizers.path(MODEL), "rb") as f:
        return _load(f.read())


def encode(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, keep: tuple[str, ...] = ()
) -> DataFrame:
    """One row per row of docs: doc_id, the columns of `keep`, ids (array of int, with begin and end id), decoded.

    Columns of `keep` that are named doc_id, ids or decoded come as kept_doc_id, kept_ids, kept_decoded; a name given twice and
    `id_col` itself count once. A null text counts as empty: its ids are the begin and end id, decoded is empty. Rows without id, repeated rows
    and very long texts are encoded like any other; an empty table has no rows. path names a model file that every executor can read
    (None: the installed public one). Other columns are not looked at.
    """
    keep = tuple(c for c in dict.fromkeys(keep) if c != id_col)
    shown = [f"kept_{c}" if c in ("doc_id", "ids", "decoded") else c for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                raw = [t.encode_bytes(x.as_py() or "") for x in part.column(part.num_columns - 1)]
                flat = np.frombuffer(b"".join(raw), "<i4")
                ends = np.cumsum([0] + [len(x) // 4 for x in raw]).astype(np.int32)
                decoded = [t.decode(flat[a:b].tolist()) for a, b in zip(ends, ends[1:])]
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
                others = [part.column(k) for k in range(part.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*others, ids, pa.array(decoded, pa.string())], names)

    names = ["doc_id", *shown, "ids", "decoded"]
    by_name = dict(zip(docs.columns, fields(docs)))
    # numbered on the way, so that no name of theirs clashes
    others = [by_name[c].alias(f"_{i}") for i, c in enumerate(keep)]
    rows = docs.select(by_name[id_col].cast("long").alias("doc_id"), *others, by_name[text_col].cast("string").alias("text"))
    kept = [StructField(name, f.dataType) for name, f in zip(["doc_id", *shown], rows.schema.fields)]
    schema = StructType([*kept, StructField("ids", ArrayType(IntegerType())), StructField("decoded", StringType())])
    return rows.mapInArrow(run, schema)


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """As encode, but with n_tokens and digests in place of the ids and the decoded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table(path)
        for batch in batches:
            counts, ids_sha, text_sha = [], [], []
            for x in batch.column(1):
                raw = t.encode_bytes(x.as_py() or "")
                counts.append(len(raw) // 4)
                ids_sha.append(hashlib.sha256(raw).hexdigest())
                text_sha.append(hashlib.sha256(t.decode(np.frombuffer(raw, "<u4").tolist()).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract columns for every document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return digest(read(spark, sf_dir, "documents"))
