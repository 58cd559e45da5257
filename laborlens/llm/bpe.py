"""Exact BPE by dynamic programming over prefixes.

A word is a string of symbols (bytes; the last one also carries the end-of-word mark). For each of its prefixes exactly
one vocabulary token can come last in the encoding of that prefix. An Aho-Corasick suffix automaton of the vocabulary
gives the tokens that end at each symbol; a candidate is right if the prefix it leaves has its own last token and that
pair of tokens is one the merges could leave standing side by side. Back-pointers then give the ids. Time is linear in the
word, whatever the order of merges, and no merge loop runs.

The vocabulary file is a `tokenizers` BPE model with an end-of-word suffix; its path is a parameter, read on the driver and
broadcast (its size is the model's, not the data's). Words repeat, so encodings are kept in a cache of bounded size.

Defined cases: null text counts as empty and has no ids; special tokens' strings in a text become their ids, as in the
library; repeated rows each get a row; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_CACHED = 150_000
#: The library's \\s: Unicode's White_Space, which is not Python's \\s.
_WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def _byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def unicode_classes() -> dict[str, str | dict[int, str]]:
    r"""What the library's own Unicode version calls \p{L} and \p{N}, as regex ranges, and its lower case where Python's differs."""
    from tokenizers import Regex, normalizers, pre_tokenizers

    every = [chr(n) for n in range(0x110000) if not 0xD800 <= n < 0xE000]
    out: dict = {}
    for name in ("L", "N"):
        split = pre_tokenizers.Split(Regex(rf"\p{{{name}}}"), "removed", invert=True)
        codes = sorted({ord(c) for c, _ in split.pre_tokenize_str(" ".join(every))})
        starts = [c for c, before in zip(codes, [None, *codes], strict=False) if before != c - 1]
        ends = [c for c, after in zip(codes, [*codes[1:], None], strict=True) if after != c + 1]
        out[name] = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends, strict=True))
    lower = normalizers.Lowercase().normalize_str
    out["lower"] = {ord(c): y for c in every if c != "Σ" and (y := lower(c)) != c.lower()} | {ord("Σ"): "σ"}
    return out


def _narrow(ranges: str) -> str:
    """The part of regex ranges up to U+FFFF."""
    pairs = [(int(a, 16), int(b, 16)) for a, b in re.findall(r"\\U(\w{8})-\\U(\w{8})", ranges)]
    return "".join(f"\\U{a:08x}-\\U{min(b, 0xFFFF):08x}" for a, b in pairs if a <= 0xFFFF)


def _pieces(pattern: str, classes: dict) -> Callable[[str], list[str]]:
    """findall of the file's split pattern, its \\p{L}, \\p{N} and \\s written out as ranges."""
    inside, alone = re.compile(r"\[\^([^\]]*)\]"), {rf"\p{{{k}}}": classes[k] for k in "LN"}
    swap = lambda text, form: functools.reduce(lambda t, k: t.replace(k, form.format(alone[k])), alone, text)
    pattern = inside.sub(lambda m: swap(m[0], "{}"), pattern)
    return re.compile(swap(pattern, "[{}]").replace(r"\s", _WHITE)).findall


class Bpe:
    """encode(text) -> ids and decode(ids) -> text, as the tokenizers library for the same file."""

    def __init__(self, model: str, classes: dict | None = None):
        classes = classes or unicode_classes()
        spec = json.loads(model)
        bpe = spec["model"]
        end = bpe["end_of_word_suffix"]
        if bpe["type"] != "BPE" or not end or bpe.get("dropout") or bpe.get("byte_fallback"):
            raise ValueError("a BPE model with an end-of-word suffix is needed")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text_of = {i: t for t, i in bpe["vocab"].items()} | {i: t for t, i in self.special.items()}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        pattern = split["pattern"]["Regex"].replace(r"[\p{L}]", r"\p{L}").replace(r"[\p{N}]", r"\p{N}")
        self.pieces = _pieces(pattern, classes)
        # characters over U+FFFF make Python's classes slow to miss, so texts without them, nearly all, get classes without them;
        # the same search finds characters of other lower case, whose lower case may be any
        self.narrow_pieces = _pieces(pattern, {k: _narrow(classes[k]) for k in "LN"})
        self.lower = classes["lower"]
        self.rare = re.compile("[\U00010000-\U0010ffff" + "".join(re.escape(chr(c)) for c in self.lower if c <= 0xFFFF) + "]").search
        self.cuts = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

        symbol = {c: chr(b) for b, c in enumerate(_byte_chars())}
        last = {c: chr(256 + b) for b, c in enumerate(_byte_chars())}

        def symbols(token: str) -> str:
            return "".join(symbol[c] for c in token[: -len(end) - 1]) + last[token[-len(end) - 1]] if token.endswith(end) and len(token) > len(end) else "".join(symbol[c] for c in token)

        # own order: single symbols first, then merges as they rank
        names = [*(f"{c}" for c in _byte_chars()), *(f"{c}{end}" for c in _byte_chars())]
        order = {t: k for k, t in enumerate(names)}
        self.parts: list[tuple[int, int]] = [(k, k) for k in range(512)]
        self.pair: dict[tuple[int, int], int] = {}
        for merge in bpe["merges"]:
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            if (joined := a + b) in order:
                raise ValueError(f"two merges make {joined!r}")
            order[joined] = self.pair[order[a], order[b]] = len(self.parts)
            self.parts.append((order[a], order[b]))
            names.append(joined)
        self.ids = [bpe["vocab"][t] for t in names]
        self.sizes = [len(symbols(t)) for t in names]
        self.fits = functools.lru_cache(500_000)(self._fits)
        self.matches = ahocorasick.Automaton()
        for k, t in enumerate(names):
            if k < 512 or self._stands(k):
                self.matches.add_word(symbols(t), k)
        self.matches.make_automaton()
        self.cache: dict[str, tuple[int, bytes, str]] = {}

    def _stands(self, token: int) -> bool:
        """Whether the token's own text is encoded as that token."""
        a, b = self.parts[token]
        return self._fits(a, b, below=token)

    def _fits(self, a: int, b: int, below: int | None = None) -> bool:
        """Whether tokens a and b can stand side by side: no merge across their border would have come before those
        inside them. Undoes the later of the two tokens' merges in turn and looks at what then touched."""
        limit = len(self.parts) if below is None else below
        pair, parts = self.pair, self.parts
        while True:
            if (joined := pair.get((a, b))) is not None and joined < limit:
                return False
            if a < 512 and b < 512:
                return True
            if a > b:
                limit, a = a, parts[a][1]
            else:
                limit, b = b + 1, parts[b][0]

    def word(self, piece: str) -> list[int]:
        raw = piece.encode()
        text = "".join(map(chr, raw[:-1])) + chr(256 + raw[-1])
        back = [-1] * len(text)
        sizes, fits = self.sizes, self.fits
        for end, token in self.matches.iter(text):
            if back[end] < 0:
                before = end - sizes[token]
                if before < 0 or (back[before] >= 0 and fits(back[before], token)):
                    back[end] = token
        out, at = [], len(text) - 1
        while at >= 0:
            out.append(back[at])
            at -= sizes[back[at]]
        return [self.ids[k] for k in reversed(out)]

    def _learn(self, piece: str) -> tuple[int, bytes, str]:
        ids = self.word(piece)
        if len(self.cache) >= _CACHED:
            self.cache.clear()
        known = self.cache[piece] = (len(ids), array("I", ids).tobytes(), self.decode(ids))
        return known

    def _spans(self, text: str) -> list[tuple[int, bytes, str]]:
        """(count, ids as little-endian unsigned 32-bit integers, decoded) of each word or special token."""
        known, learn, out = self.cache.get, self._learn, []
        for k, part in enumerate(self.cuts.split(text) if self.cuts else [text]):
            if k % 2:
                out.append((1, array("I", [self.special[part]]).tobytes(), part))
                continue
            plain = unicodedata.normalize("NFC", part)
            rare = self.rare(plain)
            plain = (plain.translate(self.lower) if rare else plain).lower()
            out += [known(p) or learn(p) for p in (self.pieces if rare else self.narrow_pieces)(plain)]
        return out

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return b"".join([x[1] for x in self._spans(text or "")])

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.text_of[i] for i in ids])

    def both(self, text: str | None) -> tuple[int, bytes, str]:
        """count, ids, and the decoded text: words decode on their own, joined by one space, as the file has no decoder."""
        counts, ids, words = zip(*(self._spans(text or "") or [(0, b"", "")]), strict=True)
        return sum(counts), b"".join(ids), " ".join(words)


_built: dict[str, Bpe] = {}


def _of(model: str, classes: dict) -> Bpe:
    """One automaton for each Python worker, not for each task."""
    key = hashlib.sha256(model.encode()).hexdigest()
    if key not in _built:
        _built.clear()
        _built[key] = Bpe(model, classes)
    return _built[key]


def tokenized(docs: DataFrame, tokenizer: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, text) -> (doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]), a row for each row; ids: binary, as `encode`."""
    with open(tokenizer, encoding="utf-8") as f:
        model = docs.sparkSession.sparkContext.broadcast((f.read(), unicode_classes()))
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _of(*model.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                out = [bpe.both(t.as_py()) for t in batch.column(1)]
                hexed = lambda xs: pa.array([hashlib.sha256(x).hexdigest() for x in xs], pa.string())
                cols = [batch.column(0), pa.array([x[0] for x in out], pa.int64()), hexed(x[1] for x in out), hexed(x[2].encode() for x in out)]
                yield pa.RecordBatch.from_arrays(cols + [pa.array([x[1] for x in out], pa.binary())] * with_ids, names=names)

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, schema)
