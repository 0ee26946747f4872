"""BPE encoding and decoding with a pair occurrence index.

The distinct pieces of a run of texts are laid out as one symbol sequence. An
index maps each mergeable pair, by its rank, to all its positions; the active
ranks are applied in ascending order, and each merge updates the lists of the
two pairs it touches. Texts are then put together from their pieces.

The vocabulary, the merges, the normalisation and the split into pieces are
those of a public tokenizer file (JSON of the ``tokenizers`` library).
"""

from __future__ import annotations

import gc
import heapq
import json
import re
from collections.abc import Iterator
from itertools import chain
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE_BYTES = 8 << 20
CACHE_PIECES = 500_000
#: Texts of ASCII and Latin-1 letters without control characters are stable
#: under NFC, and their pieces under the tokenizer's pattern are found without
#: the library.
PLAIN = re.compile("[ \t\n\r\f\v!-~À-ÖØ-öø-ÿ]*")
PLAIN_PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^ \t\n\r\f\va-zß-öø-ÿ0-9]+")
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_characters() -> list[str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves,
    the others follow from code point 256 on."""
    own = [33 <= b <= 126 or 161 <= b <= 172 or 174 <= b for b in range(256)]
    return [chr(b) if own[b] else chr(256 + sum(not o for o in own[:b])) for b in range(256)]
MAX_FILE_BYTES = 64 << 20


class PairIndexBpe:
    def __init__(self, file_text: str):
        from tokenizers import Tokenizer

        spec = json.loads(file_text)
        model = spec["model"]
        library = Tokenizer.from_str(file_text)
        self.normalizer, self.pre_tokenizer = library.normalizer, library.pre_tokenizer
        self.vocab = model["vocab"]
        suffix = model["end_of_word_suffix"] or ""
        self.plain = PATTERN in file_text.replace("\\\\", "\\") and [n["type"] for n in spec["normalizer"]["normalizers"]] == ["NFC", "Replace", "Lowercase"]
        characters = byte_characters()
        self.byte_of = {c: b for b, c in enumerate(characters)}
        self.inner = [self.vocab.get(c, -1) for c in characters]
        self.last = [self.vocab.get(c + suffix, -1) for c in characters]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.word_of = {i: w for w, i in [*self.vocab.items(), *self.added.items()]}
        self.special = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.width = max(self.word_of) + 1
        merges = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        self.left, self.right, self.product = (
            np.array([self.vocab[x] for x in side], np.int64) for side in zip(*((a, b, a + b) for a, b in merges)))
        made = np.full(self.width, -1)
        made[self.product] = np.arange(len(merges))
        if len(np.unique(self.product)) < len(merges) or (np.maximum(made[self.left], made[self.right]) >= np.arange(len(merges))).any():
            raise ValueError("a merge stands before the merges that make its parts")
        code = self.left * self.width + self.right
        self.code_rank = np.argsort(code)
        self.codes = code[self.code_rank]

    def symbols(self, piece: str) -> list[int]:
        """A piece's first symbols; bytes outside the vocabulary have none."""
        raw = piece.encode()
        out = [self.inner[b] for b in raw]
        out[-1] = self.last[raw[-1]]
        return out if min(out) >= 0 else [x for x in out if x >= 0]

    def pieces(self, text: str) -> list[str]:
        """The pieces of a text without special tokens."""
        if self.plain and PLAIN.fullmatch(text):
            return PLAIN_PIECE.findall(text.lower())
        cut = self.pre_tokenizer.pre_tokenize_str(self.normalizer.normalize_str(text))
        return [bytes(self.byte_of[c] for c in p).decode() for p, _ in cut if p]

    def split(self, text: str) -> list[str]:
        """A text's special tokens and pieces."""
        if self.special is None or not self.special.search(text):
            return self.pieces(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [*self.pieces(text[at:m.start()]), m.group()]
            at = m.end()
        return out + self.pieces(text[at:])

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The merge rank of each pair of symbols, -1 for none."""
        code = a * self.width + b
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.code_rank[at], -1)

    def merge(self, pieces: list[list[int]]) -> list[np.ndarray]:
        """Every piece's symbols after all merges.

        A merge makes pairs of later ranks only (checked when the file is
        read), so all positions of the least active rank are merged at once.
        """
        sizes = np.array([len(p) for p in pieces], np.int64)
        begin = np.cumsum(sizes) - sizes
        sym = np.fromiter((x for p in pieces for x in p), np.int64, int(sizes.sum()))
        after, before = np.arange(1, len(sym) + 1), np.arange(-1, len(sym) - 1)
        some = sizes > 0
        after[(begin + sizes - 1)[some]] = -1
        before[begin[some]] = -1
        places: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def index(at: np.ndarray) -> None:
            """Add the pairs that begin at the positions to their lists."""
            rank = self.ranks(sym[at], sym[after[at]])
            at, rank = at[rank >= 0], rank[rank >= 0]
            if not len(at):
                return
            by = np.argsort(rank, kind="stable")
            at, rank = at[by], rank[by]
            cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            for r, part in zip(rank[np.concatenate([[0], cuts])].tolist(), np.split(at, cuts)):
                if r in places:
                    places[r].append(part)
                else:
                    places[r] = [part]
                    heapq.heappush(active, r)

        index(np.flatnonzero(after >= 0))
        while active:
            rank = heapq.heappop(active)
            left, right, new = self.left[rank], self.right[rank], self.product[rank]
            i = np.unique(np.concatenate(places.pop(rank)))
            i = i[(sym[i] == left) & (after[i] >= 0)]
            i = i[sym[after[i]] == right]  # others lost a symbol to an earlier merge
            if left == right and len(i):
                # of overlapping pairs in a run, every other one from the left
                first = np.concatenate([[True], i[1:] != after[i[:-1]]])
                head = np.maximum.accumulate(np.where(first, np.arange(len(i)), 0))
                i = i[(np.arange(len(i)) - head) % 2 == 0]
            if not len(i):
                continue
            j = after[i]
            k = after[j]
            sym[i], sym[j], after[i] = new, -1, k
            before[k[k >= 0]] = i[k >= 0]
            p = before[i]
            index(np.unique(np.concatenate([i[k >= 0], p[p >= 0]])))
        alive = sym >= 0
        ends = np.concatenate([[0], np.cumsum(alive)])
        return np.split(sym[alive], ends[begin[1:]]) if len(pieces) else []

    def encode_pieces(self, pieces: list[str]) -> list[list[int]]:
        return [ids.tolist() for ids in self.merge([self.symbols(p) for p in pieces])]


def _encoder(shipped, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # millions of small objects, none of them in a cycle
        bpe = PairIndexBpe(shipped.value)
        packed_of: dict[str, bytes] = {}
        shown_of: dict[str, str] = {}

        def learn(new: list[str]) -> None:
            for p, ids in zip(new, bpe.encode_pieces(new)):
                packed_of[p] = pack("<%dI" % len(ids), *ids)
                shown_of[p] = " ".join([bpe.word_of[i] for i in ids])

        def flush(rows: pa.RecordBatch, texts: list[str | None]) -> pa.RecordBatch:
            cut = [bpe.split(t or "") for t in texts]
            if len(packed_of) > CACHE_PIECES:
                packed_of.clear()
                shown_of.clear()
            for word, i in bpe.added.items():
                packed_of[word], shown_of[word] = pack("<I", i), word
            learn(list(set(chain.from_iterable(cut)).difference(packed_of)))
            packed = [b"".join(map(packed_of.__getitem__, d)) for d in cut]
            shown = [" ".join(filter(None, map(shown_of.__getitem__, d))) for d in cut]
            columns = [*rows.columns, pa.array([len(x) // 4 for x in packed], pa.int64()), pa.array(packed, pa.binary()), pa.array(shown, pa.string())]
            return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

        for batch in batches:
            kept = batch.drop_columns("__text")
            at, held, texts = 0, 0, []
            for i, t in enumerate(batch.column("__text")):
                texts.append(t.as_py())
                held += len(texts[-1] or "")
                if held >= SLICE_BYTES or i == batch.num_rows - 1:
                    yield flush(kept.slice(at, i + 1 - at), texts)
                    at, held, texts = i + 1, 0, []

    return run


def encode(docs: DataFrame, tokenizer_file: str, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep`` of every row, and n_tokens, ids (little-endian unsigned
    32-bit integers) and decoded (the tokens of the ids, joined by a space, as
    the library does for a tokenizer without a decoder).

    Null and empty texts have no ids and decode to the empty string; repeated
    rows are encoded each; an empty table gives no rows; columns of ``docs``
    not in ``keep``, clashing names included, are not read; ``keep`` must not
    name an output. Texts are handled whole and held one slice of a few MB at a
    time; nothing is shuffled. The tokenizer file (checked to be at most 64 MB)
    is sent to the executors.
    """
    clash = {"n_tokens", "ids", "decoded", "__text"} & set(keep)
    if clash:
        raise ValueError(f"columns with names of outputs: {sorted(clash)}")
    with open(tokenizer_file, encoding="utf-8") as f:
        content = f.read(MAX_FILE_BYTES + 1)
    if len(content) > MAX_FILE_BYTES:
        raise ValueError("the tokenizer file is larger than the bound for broadcasts")
    spec = json.loads(content)
    if spec["model"]["type"] != "BPE" or spec["decoder"] is not None or spec["model"].get("byte_fallback"):
        raise ValueError("a BPE tokenizer file without decoder and byte fallback is needed")
    rows = docs.select(*[docs[c] for c in keep], docs[text].alias("__text"))
    out = rows.drop("__text").withColumns({
        "n_tokens": F.lit(0).cast("long"), "ids": F.lit(b""), "decoded": F.lit("")
    }).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    shipped = docs.sparkSession.sparkContext.broadcast(content)
    return rows.mapInArrow(_encoder(shipped, to_arrow_schema(out)), out)


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
