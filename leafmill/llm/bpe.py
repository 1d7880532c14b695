"""BPE encoding and decoding over a trie of distinct words.

The vocabulary file is one of the `tokenizers` library's: BPE with an end-of-word suffix, words split by its pattern.
Of each Arrow batch the distinct words not yet known are put into a trie, held as the sorted words with the depth at
which each leaves its predecessor: this is the trie's depth-first order. The walk keeps, for every prefix on the path,
the last token of that prefix's encoding. The next prefix's last token t is the one that ends there, such that t may
follow the last token of the prefix before t; so a prefix shared by many words is encoded once. A word's encoding is
read backwards through these last tokens.

Two tokens may follow each other if merging their joined symbols gives back just these two; each pair is tried once per
worker. Words already encoded are looked up. Both tables are emptied when full, which costs time but no results.

Defined results: null text is empty text, with no tokens; whole texts of any length are encoded; rows repeat as they
are; other columns of the input are ignored unless named as keys. Strings of special tokens in a text become these
tokens, as in the library.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from leafmill.session import resident, small_arrow_batches

#: The split pattern of the vocabulary file (fixed value; white space by its Unicode property).
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
#: Characters outside these long-settled ranges are left to the library, whose Unicode tables may differ from Python's.
RARE = regex.compile(r"[^\x00-\u0233\u0386\u0388-\u038A\u038C\u038E-\u03A1\u03A3-\u03CE\u0400-\u0481\u1E00-\u1E99\u2000-\u2063\u20A0-\u20B1\u3041-\u3094\u30A1-\u30FA\u4E00-\u9FA5]")
END = 256  # added to the symbol of a word's last byte
KNOWN_WORDS = 200_000
KNOWN_PAIRS = 1_000_000


class Encoder:
    """Encodes and decodes by one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != "</w>" or spec["decoder"] is not None or spec["post_processor"] is not None:
            raise ValueError("not a word BPE vocabulary")
        vocab = model["vocab"]
        printed = self._byte_characters()
        #: Symbols are characters: chr(byte), or chr(byte + END) for the last byte of a word.
        self.symbols: dict[int, str] = {}
        for b in range(256):
            self.symbols[vocab[printed[b]]] = chr(b)
            self.symbols[vocab[printed[b] + "</w>"]] = chr(b + END)
        self.raw = {c: b for b, c in enumerate(printed)}
        self.library = Tokenizer.from_file(path)
        self.base = {s: t for t, s in self.symbols.items()}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (left, right) in enumerate(model["merges"]):
            a, b, whole = vocab[left], vocab[right], vocab[left + right]
            self.merges[a, b] = (rank, whole)
            self.symbols[whole] = self.symbols[a] + self.symbols[b]
        self.texts = {t: s.encode() for s, t in vocab.items()} | {x["id"]: x["content"].encode() for x in spec["added_tokens"]}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        #: Tokens by their symbols from last to first.
        self.backwards: dict = {}
        for t, s in self.symbols.items():
            node = self.backwards
            for c in reversed(s):
                node = node.setdefault(c, {})
            node[""] = t
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}

    @staticmethod
    def _byte_characters() -> list[str]:
        """The printable character that stands for each byte in byte-level vocabularies."""
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
        others = iter(range(256, 512))
        return [chr(b) if b in plain else chr(next(others)) for b in range(256)]

    def merged(self, symbols: str) -> list[int]:
        """BPE of a short run of symbols by its definition: the best-ranked pair first, leftmost of equals."""
        tokens = [self.base[c] for c in symbols]
        while len(tokens) > 1:
            found = [(self.merges[p][0], k) for k in range(len(tokens) - 1) if (p := (tokens[k], tokens[k + 1])) in self.merges]
            if not found:
                break
            _, k = min(found)
            tokens[k : k + 2] = [self.merges[tokens[k], tokens[k + 1]][1]]
        return tokens

    def follows(self, before: int, token: int) -> bool:
        """If token may come after `before` in an encoding; before is -1 at the start of a word."""
        key = (before + 1) << 20 | token
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= KNOWN_PAIRS:
                self.pairs.clear()
            head = "" if before < 0 else self.symbols[before]
            known = self.pairs[key] = self.merged(head + self.symbols[token]) == ([token] if before < 0 else [before, token])
        return known

    def walk(self, words: Iterable[str]) -> None:
        """Encode distinct words by a depth-first walk of their trie; results go to self.words."""
        keyed = []
        for w in words:
            b = w.encode("utf-8", "replace").decode("latin-1")
            keyed.append((b[:-1] + chr(ord(b[-1]) + END), w))
        keyed.sort()
        last, previous = [-1], ""
        symbols, pairs, follows, root = self.symbols, self.pairs, self.follows, self.backwards
        for path, word in keyed:
            depth, most = 0, min(len(path), len(previous))
            while depth < most and path[depth] == previous[depth]:
                depth += 1
            del last[depth + 1 :]
            for i in range(depth, len(path)):
                node, at, ends = root, i, []
                while at >= 0 and (node := node.get(path[at])) is not None:
                    if (t := node.get("")) is not None:
                        ends.append((t, last[at]))
                    at -= 1
                for t, before in reversed(ends):  # the longest first; just one fits
                    ok = pairs.get((before + 1) << 20 | t)
                    if follows(before, t) if ok is None else ok:
                        last.append(t)
                        break
                else:
                    raise AssertionError("no token ends here")
            ids, at = [], len(path)
            while at > 0:
                ids.append(last[at])
                at -= len(symbols[last[at]])
            self.words[word] = np.array(ids[::-1], dtype="<u4").tobytes()
            previous = path

    def split(self, text: str) -> list[str]:
        """The words of a text without special tokens, as the library normalises and splits it."""
        if not text.isascii():
            if RARE.search(text):
                cut = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
                return [bytes(map(self.raw.__getitem__, w)).decode() for w, _ in cut]
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower case goes by single characters
        return PIECES.findall(text.lower())

    def segments(self, text: str) -> list[list[str] | int]:
        """Lists of words, and between them the ids of special tokens."""
        if self.special_pattern is None or not self.special_pattern.search(text):
            return [self.split(text)]
        return [self.special[s] if s in self.special else self.split(s) for s in self.special_pattern.split(text)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        cut = [self.segments(t) for t in texts]
        fresh = {w for segments in cut for s in segments if isinstance(s, list) for w in s}
        if len(self.words) + len(fresh) > KNOWN_WORDS:
            self.words.clear()
        self.walk(fresh - self.words.keys())
        of = self.words.__getitem__
        return [b"".join([b"".join(map(of, s)) if isinstance(s, list) else s.to_bytes(4, "little") for s in segments]) for segments in cut]

    def decode(self, ids: bytes) -> str:
        """The tokens' strings with a space between, as the library decodes without a decoder."""
        return b" ".join(map(self.texts.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode()


def encoder(path: str) -> Encoder:
    """This process's encoder for a vocabulary file."""
    return resident(("bpe", path), lambda: Encoder(path))


def pieces(texts: list[str | None], size: int = 2_000_000) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about so many characters, with the index of the first."""
    at, run, held = 0, [], 0
    for k, t in enumerate(texts):
        run.append(t or "")
        held += len(run[-1])
        if held >= size:
            yield at, run
            at, run, held = k + 1, [], 0
    if run:
        yield at, run


def encode(docs: DataFrame, path: str, text: str = "text", keys: tuple[str, ...] = ("doc_id",), decode: bool = False) -> DataFrame:
    """The keys, `n_tokens`, `ids` (binary, little-endian unsigned 32-bit) and, if asked for, `decoded` of each row.

    The vocabulary file must be at `path` on every executor.
    """
    small_arrow_batches(docs.sparkSession)
    narrow = docs.select(*[F.col(k) for k in keys], F.col(text).alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1]), "n_tokens long, ids binary", *["decoded string"] * decode])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = encoder(path)
        for b in batches:
            for at, texts in pieces(b.column("__text").to_pylist()):
                ids = by.encode(texts)
                columns = [*(b.column(k).slice(at, len(texts)) for k in keys), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
                if decode:
                    columns.append(pa.array(list(map(by.decode, ids)), pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[*keys, "n_tokens", "ids", *["decoded"] * decode])

    return narrow.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    done = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), decode=True)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
