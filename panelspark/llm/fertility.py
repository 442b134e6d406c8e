"""Quality rules from tokeniser fertility: how public vocabularies cut a text.

Two vocabularies measure each text: a byte-level one (characters per token, entropy of
its tokens) and one with byte fallback (share of tokens that are single bytes). Ordinary
prose of a script falls into narrow bands of these; symbols, shouting and noise do not.
The bands, by language and by script for other languages, are fixed values below. A text
that the base rules reject is rejected whatever its bands say.

Nulls: a null text has no words and fails the base rules; a null or unknown language is
judged by the script of most of the text's letters.
"""

from __future__ import annotations

import base64
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

TOKENIZERS = "/opt/tokenizers"
BYTE_LEVEL = "byte_bpe_multi_50k.tiktoken"
FALLBACK = "piece_bpe_32k.model"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOL = re.compile(r"[#*$%&|<>]")
MIN_WORDS, MAX_REPEATED = 50, 50
#: Fixed values. For each language or script: least and most characters per token, most share of byte tokens in
#: percent (line ends not counted), least and most entropy of the token distribution in bits.
BANDS = {
    "en": (2.30, 6.0, 4.0, 4.8, 13.0),
    "de": (2.40, 6.0, 4.0, 4.8, 13.0),
    "fr": (2.08, 6.0, 4.0, 4.8, 13.0),
    "es": (2.20, 6.0, 4.0, 4.8, 13.0),
    "latin": (1.80, 7.0, 8.0, 4.5, 13.0),
    "cyrillic": (0.9, 7.0, 20.0, 4.5, 13.0),
    "greek": (0.5, 6.0, 60.0, 4.0, 13.0),
    "han": (0.3, 4.0, 80.0, 4.5, 13.0),
    "other": (0.2, 7.0, 100.0, 4.0, 13.0),
}
SCRIPTS = ((0x0041, 0x024F, "latin"), (0x0370, 0x03FF, "greek"), (0x0400, 0x052F, "cyrillic"), (0x3040, 0x30FF, "han"), (0x4E00, 0x9FFF, "han"))


def base(text: str | None) -> tuple[int, int, int, int, int, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    words = WORD.findall(text)
    n = len(words)
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif WORD.search(line):
            seen.add(line)
    repeat = 0
    if n >= 4:
        names: dict[str, int] = {}
        ids = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, n)
        size = len(names)
        pair = np.unique(ids[:-1] * size + ids[1:], return_inverse=True)[1].astype(np.int64)
        _, at, count = np.unique(pair[:-1] * size + ids[2:], return_inverse=True, return_counts=True)
        start = np.flatnonzero(count[at] > 1)
        hit = np.zeros(n, bool)
        for k in range(3):
            hit[start + k] = True
        repeat = int(hit.sum())
    return n, sum(map(len, words)), len(SYMBOL.findall(text)), dup, repeat, n < MIN_WORDS or 100 * repeat > MAX_REPEATED * n


def script(text: str) -> str:
    """The script of most letters of the text; ties in the order of SCRIPTS."""
    count = Counter()
    for c, k in Counter(text).items():
        if c.isalpha():
            count[next((name for lo, hi, name in SCRIPTS if lo <= ord(c) <= hi), "other")] += k
    return max(count, key=count.__getitem__) if count else "other"


class Meter:
    """The two vocabularies, opened once by each Python worker."""

    def __init__(self, folder: str):
        import sentencepiece
        import tiktoken
        from public_tokenizers import PATTERN

        with open(f"{folder}/{BYTE_LEVEL}", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        self.byte_level = tiktoken.Encoding("fertility", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.fallback = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{FALLBACK}")
        self.bytes = np.array([self.fallback.is_byte(i) for i in range(self.fallback.get_piece_size())])
        self.bytes[[self.fallback.piece_to_id(f"<0x{b:02X}>") for b in (9, 10, 13)]] = False

    def __call__(self, text: str) -> tuple[float, float, float]:
        """Characters per token, share of byte tokens in percent, entropy of the tokens in bits."""
        ids = np.asarray(self.byte_level.encode_ordinary(text), np.int64)
        if not len(ids):
            return 0.0, 0.0, 0.0
        share = np.unique(ids, return_counts=True)[1] / len(ids)
        entropy = float(-(share * np.log2(share)).sum())
        pieces = np.asarray(self.fallback.encode(text, num_threads=1), np.int64)
        return len(text) / len(ids), 100 * float(self.bytes[pieces].mean()) if len(pieces) else 0.0, entropy


def verdict(lang: str | None, text: str, chars: float, fall: float, entropy: float) -> bool:
    lo, hi, most, least, top = BANDS[lang if lang in BANDS else script(text)]
    return lo <= chars <= hi and fall <= most and least <= entropy <= top


def rules(docs: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """The base counts, the three measures and the verdict ``kept`` of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meter = Meter(folder)
        names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "chars_per_token", "byte_share", "token_entropy"]
        kinds = [pa.int64()] * 6 + [pa.bool_()] * 2 + [pa.float64()] * 3
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                rows = []
                for doc, text, lang in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    got, marks = base(text), meter(text or "")
                    rows.append((doc, *got, not got[-1] and verdict(lang, text, *marks), *marks))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return docs.selectExpr("cast(doc_id as long) doc_id", "text", "cast(lang as string) lang").mapInArrow(
        run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, chars_per_token double, byte_share double, token_entropy double"
    )
