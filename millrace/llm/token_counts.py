"""Token counts by the whole-token shortcut.

Most words of a text are one token. Which vocabulary strings are so is proved beforehand: the
tokenizer itself encodes every word-ending string of its vocabulary alone. A text is then split
as the tokenizer splits it, proved pieces count 1 at once, and only other pieces go through the
merges of the byte-pair model, once for every distinct piece that a worker meets.

The splitting pattern of this vocabulary is restated for the characters whose case, class and
normal form all Unicode versions agree on (Latin and common punctuation). Runs between blanks
that hold any other character are encoded by the library, as pieces do not reach over blanks. A
tokenizer file with another normaliser or splitting pattern is counted by the library throughout.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 2048
VOCABULARY = "word_bpe_49k.json"
#: Pieces kept besides the proved ones; beyond that they are forgotten and merged anew.
REMEMBERED = 500_000

# Letters and numbers among the characters of the fast path, after lower-casing.
LETTERS = "a-zA-ZªµºÀ-ÖØ-öø-ɏ"
NUMBERS = "0-9²³¹¼-¾"
SPACES = " \t\n\x0b\x0c\r\xa0"
PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^{SPACES}{LETTERS}{NUMBERS}]+")
#: Not on the fast path. U+0130 changes its length in lower case; the separators \x1c-\x1f and \x85 are spaces to some libraries.
ODD = re.compile("[^\x00-\x1b\x20-\x84\x86-įı-ɏ‐-‧‰-⁞€]")

RUN = re.compile("[^ \t\n\r]+")
# The normaliser and the splitting pattern that the fast path restates.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> list[str]:
    """The letters that stand for the bytes 0 to 255 in a byte-level model: printable ones for themselves, the rest from U+0100 on."""
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    moved = iter(range(256, 512))
    return [chr(b if b in kept else next(moved)) for b in range(256)]


BYTE_LETTERS = dict(enumerate(_byte_letters()))


class Counter:
    """Counts tokens with one tokenizer file. costs: tokens of a piece of text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.split = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.fast = self.restated()
        self.whole = self.proved() if self.fast else {}
        self.costs = dict(self.whole)

    def restated(self) -> bool:
        """Whether the file splits texts as PIECES does."""
        made = json.loads(self.tokenizer.to_str())
        normalizer, splits, model = (made.get(k) or {} for k in ("normalizer", "pre_tokenizer", "model"))
        first = (splits.get("pretokenizers") or [{}])[0]
        return normalizer.get("normalizers") == NORMALIZERS and first.get("pattern") == {"Regex": PATTERN} and first.get("invert") is True and model.get("end_of_word_suffix") == "</w>"

    def encoded(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def merged(self, piece: str) -> int:
        """Tokens of one piece: its byte letters through the merges of the model."""
        return len(self.model.tokenize(piece.encode().decode("latin-1").translate(BYTE_LETTERS)))

    def proved(self) -> dict[str, int]:
        """The word-ending vocabulary strings that are one piece and encode alone as one token."""
        end = "</w>"
        words = [w.removesuffix(end) for w in self.tokenizer.get_vocab() if w.endswith(end) and len(w) > len(end)]
        words = [w for w in words if w.isascii() and PIECES.fullmatch(w)]
        return {w: 1 for w, n in zip(words, self.encoded(words), strict=True) if n == 1}

    def stretch(self, text: str) -> int:
        if not self.fast:
            return self.encoded([text])[0]
        if ODD.search(text):
            runs = RUN.findall(text)
            odd = [r for r in runs if ODD.search(r)]
            return self.encoded([" ".join(odd)])[0] + self.stretch(" ".join(r for r in runs if not ODD.search(r)))
        pieces = PIECES.findall(text.lower())
        try:
            return sum(map(self.costs.__getitem__, pieces))
        except KeyError:
            new = list(set(pieces).difference(self.costs))
            if len(self.costs) + len(new) > len(self.whole) + REMEMBERED:
                self.costs = dict(self.whole)
                new = list(set(pieces).difference(self.costs))
            self.costs.update(zip(new, map(self.merged, new), strict=True))
            return sum(map(self.costs.__getitem__, pieces))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.split is None or "<" not in text:
            return self.stretch(text)
        parts = self.split.split(text)  # each special string is one token of its own
        return len(parts) - 1 + sum(map(self.stretch, parts))


@functools.cache
def counter(path: str) -> Counter:
    return Counter(path)


def with_token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT, keep: list[str] | None = None) -> DataFrame:
    """docs with the struct ``_tk``: n_bytes, n_tokens and over_limit of each row's whole text.

    A null text counts as empty. Rows are neither joined nor shuffled, so null or repeated
    doc_id values do not matter; ``_tk`` replaces a column of that name. An empty table gives no rows.
    path: a tokenizers file that all executors can read. keep: the columns of docs to carry.
    """
    path = path or vocabulary_path()
    keep = [c for c in docs.columns if c != "_tk"] if keep is None else keep
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.coalesce(F.col("text"), F.lit("")).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(path)
        for batch in batches:
            texts = batch.column("text")
            n = pa.array([counts.count(t) for t in texts.to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("row"), pc.binary_length(texts).cast(pa.int64()), n], ["row", "n_bytes", "n_tokens"])

    schema = rows.select("row", F.lit(0).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_tokens")).schema
    out = rows.mapInArrow(count, schema)
    return out.select("row.*", F.struct("n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")).alias("_tk"))


def token_report(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_tokens, over_limit."""
    return with_token_counts(docs, path, limit, keep=["doc_id"]).select("doc_id", "_tk.n_bytes", "_tk.n_tokens", "_tk.over_limit")
