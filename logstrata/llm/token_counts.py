"""Token counts with a whole-token shortcut.

Before counting, the vocabulary is run once, on the driver, through the tokenizer itself: a
vocabulary string that is one pre-token and encodes to exactly its own id is
proven to be a whole token. In a text, a pre-token found in that proven set counts
one without merging; only the others go through the merges, and their counts are
kept in a bounded table.

A text of visible Latin characters and ASCII white space is cut into pre-tokens at once. Any other is cut
where a single space stands between two characters that are not
white space: the byte-level pattern starts a new pre-token at every such place,
so pieces can be counted by themselves. Whatever the pattern here might read otherwise than the library (characters
outside Latin scripts, special strings) goes to the library as it is.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .workers import Recent, lean, values

#: The published pre-token pattern of byte-level BPE, and what it comes to on ASCII.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ASCII_TOKEN = r"'(?:s|t|re|ve|m|ll|d)| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"
#: Pre-tokens whose counts are remembered.
KNOWN = 100_000
_SCHEMA = "doc_id long, n_bytes long, n_tokens long"


def byte_symbols() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: printable Latin-1
    stands for itself, the others for the characters from U+0100 on, in order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in printable}
    for b in range(256):
        if b not in out:
            out[b] = chr(0x100 + len(out) - len(printable))
    return out


def proven_whole_tokens(tokenizer: Tokenizer) -> frozenset[str]:
    """Vocabulary strings, as text, that are one pre-token and that the tokenizer encodes as themselves alone."""
    back = {c: b for b, c in byte_symbols().items()}
    pattern = regex.compile(PRE_TOKEN)
    ids, texts = [], []
    for symbol, i in tokenizer.get_vocab(with_added_tokens=False).items():
        try:
            text = bytes(back[c] for c in symbol).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        if pattern.fullmatch(text) and pattern.match(text).end() == len(text):
            ids.append(i)
            texts.append(text)
    return frozenset(t for t, i, e in zip(texts, ids, tokenizer.encode_batch(texts, add_special_tokens=False)) if e.ids == [i])


def plain_tokenizer(path: str) -> Tokenizer:
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def counter(path: str, whole: frozenset[str]) -> Callable[[str], int]:
    """A function that counts the tokens of a text, given the proven whole tokens. Its tables go with it."""
    tokenizer = plain_tokenizer(path)
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    pre_tokens, ascii_tokens = regex.compile(PRE_TOKEN).findall, re.compile(ASCII_TOKEN).findall
    odd = re.compile("[^!-~¡-\u024f\u2010-\u2027 \\t\\n\\x0b\\x0c\\r]").search
    # the merges alone, on a pre-token written in the vocabulary's symbols
    symbols, tokenize = {b: c for b, c in byte_symbols().items()}, tokenizer.model.tokenize
    known = Recent(lambda p: 1 if p in whole else len(tokenize(p.encode().decode("latin-1").translate(symbols))), KNOWN)

    def plain(text: str) -> int:
        return sum(map(known.__getitem__, ascii_tokens(text) if text.isascii() else pre_tokens(text)))

    pieces = Recent(lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids) if odd(text) else plain(text))

    def piece(text: str) -> int:
        return pieces[text] if len(text) < 64 else pieces.make(text)

    cut = regex.compile(r"(?<=\S) (?=\S)").split

    def count(text: str) -> int:
        if any(s in text for s in special):
            return len(tokenizer.encode(text, add_special_tokens=False).ids)
        if not odd(text):
            return plain(text)
        first, *rest = cut(text)
        return (piece(first) if first else 0) + sum([piece(" " + p) for p in rest])

    return count


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of ``docs``.

    Counts every whole text as the library would, without added special tokens;
    special strings inside texts count as the library's default has them. A null
    or empty text has no bytes and no tokens. Rows that repeat a doc_id are
    counted each for itself; a null doc_id stays null. Only ``doc_id`` and
    ``text`` are read.
    """

    whole = proven_whole_tokens(plain_tokenizer(tokenizer_path))  # at most one entry for each of the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer_path, whole)
        for batch in batches:
            sizes, counts = [], []
            for text in values(batch.column(1)):
                sizes.append(len((text or "").encode()))
                counts.append(count(text or ""))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lean(run), _SCHEMA).withColumn("over_limit", F.col("n_tokens") > limit)
