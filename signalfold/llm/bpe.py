"""BPE as a bounded-lookahead streaming transducer, and an incremental decoder.

The merge list fixes how far context can act leftwards: going through the rules by rank, `lookahead`
keeps for each token how many bytes beyond its end can still decide whether it survives. A token that
ends at least that far before the end of what has been read is stable, so a word of any length is encoded
window by window with memory bounded by the lookahead (`OpenWord`). BPE restarts at any of its own token
boundaries, which makes the windows join exactly. `Stream` takes a text in pieces, cuts long runs where neither
normalising nor splitting looks across, and holds a bounded part of the text and of its ids. Runs without white
space that are short are one window; their results are kept in a bounded table, through which batches of texts go.

Normalising and splitting are the file's own (`Tokenizer.normalizer` and `.pre_tokenizer`), so that every code point
falls in the class it has there; merging is done here. The decoder is a state machine over bytes: tokens append bytes,
complete UTF-8 sequences leave as text and an incomplete one waits (U+FFFD replaces what never completes). For a file
that names no decoder, as the library does, the text is the tokens' own strings with one space between them.

Defined cases: a null text is empty and has no tokens, and so has a text of white space; the strings of the file's
special tokens become their ids; equal rows get equal results, ties cannot arise; an empty table gives an empty result;
ids of any type pass through; other columns pass through, but for those named like a result, which it replaces. A run of
combining marks alone, which no place may cut, is held whole.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from signalfold.llm.store import map_batches, ship, slices

END = "</w>"
#: Entries of the table of known runs, the longest run that enters it, and the longest one that is encoded at once.
TABLE_ROWS, TABLE_CHARS, RUN_CHARS = 200_000, 48, 2048
#: Characters of a text that a stream is fed with at a time.
PIECE = 1 << 16


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    extra = iter(range(256, 512))
    return [chr(b if b in shown else next(extra)) for b in range(256)]


class MergeList:
    """Vocabulary and merges of a tokenizer file (kind: BPE with word ends)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (1 + max(max(self.vocab.values()), *self.special.values()))
        for t, i in (*self.vocab.items(), *self.special.items()):
            self.tokens[i] = t
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        v = self.vocab
        self.rank = {(v[a], v[b]): (n, v[a + b]) for n, (a, b) in enumerate(pairs)}
        shown = byte_alphabet()
        self.byte_id = [v.get(c) for c in shown]
        self.last_id = [v.get(c + END) for c in shown]
        self.length = [self._bytes(t) for t in self.tokens]
        self.lookahead = self._lookahead(pairs)
        self.window = 4 * self.lookahead

    @staticmethod
    def _bytes(token: str) -> int:
        return len(token) - (len(END) if token.endswith(END) and len(token) > len(END) else 0)

    def _lookahead(self, pairs: Iterable[tuple[str, str]]) -> int:
        """Bytes to the right of a token that can decide whether it stays, for any token.

        Rules act by rank. After (u, v) -> w: u hangs on v, so on what v hung on; v hangs on u; w on both.
        """
        past: dict[str, int] = {}
        for u, v in pairs:
            pu, pv, n = past.get(u, 0), past.get(v, 0), self._bytes(v)
            past[u] = max(pu, n + pv)
            past[v] = max(pv, pu - n)
            past[u + v] = max(past.get(u + v, 0), pu - n, pv)
        return max(past.values(), default=0) + max(self.length)

    def merge(self, ids: list[int]) -> list[int]:
        """All merges on a window (a list to work in), lowest rank first and leftmost among equals."""
        n, rank = len(ids), self.rank
        if n <= 64:
            none = (len(rank), -1)
            rules = [rank.get(p, none) for p in zip(ids, ids[1:])]
            while rules:
                rule = min(rules)
                made = rule[1]
                if made < 0:
                    break
                at = rules.index(rule)
                ids[at:at + 2] = [made]
                del rules[at]
                if at:
                    rules[at - 1] = rank.get((ids[at - 1], made), none)
                if at < len(rules):
                    rules[at] = rank.get((made, ids[at + 1]), none)
            return ids
        nxt, prev = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r[0], i, r[1], ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, made, a, b = heapq.heappop(heap)
            j = nxt[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = made, -1
            nxt[i] = nxt[j]
            if nxt[j] >= 0:
                prev[nxt[j]] = i
            for p, q in ((prev[i], i), (i, nxt[i])):
                if p >= 0 and q >= 0 and (r := rank.get((ids[p], ids[q]))):
                    heapq.heappush(heap, (r[0], p, r[1], ids[p], ids[q]))
        return [x for x in ids if x >= 0]

    def word(self, run: bytes) -> Iterable[int]:
        """Ids of one word, at once if it is one window."""
        if not run or len(run) > self.window:
            return self.transduce(run)
        ids = [self.byte_id[b] for b in run]
        ids[-1] = self.last_id[run[-1]]
        return self.merge(ids)

    def transduce(self, run: bytes) -> Iterator[int]:
        """Ids of one word, each as soon as it is stable."""
        word = OpenWord(self)
        yield from word.feed(run)
        yield from word.finish()


class OpenWord:
    """A word that comes in pieces: ids leave once stable, and at most a window and the lookahead of bytes stay."""

    def __init__(self, merges: MergeList):
        self.merges, self.rest = merges, b""

    def feed(self, more: bytes) -> Iterator[int]:
        m, run, start = self.merges, self.rest + more, 0
        while len(run) - start > m.window + m.lookahead:
            stop = start + m.window + m.lookahead
            for t in m.merge([m.byte_id[b] for b in run[start:stop]]):
                if start + m.length[t] > stop - m.lookahead:
                    break
                yield t
                start += m.length[t]
        self.rest = run[start:]

    def finish(self) -> Iterator[int]:
        run, self.rest, m = self.rest, b"", self.merges
        ids = [m.byte_id[b] for b in run[:-1]]
        if run:
            ids.append(m.last_id[run[-1]])
        yield from m.merge(ids)


@lru_cache(maxsize=4)
def merge_list(path: str) -> MergeList:
    return MergeList(path)


#: Words that the file's normaliser and splitter leave as they are: of ASCII but the apostrophe (which starts
#: contractions), and of the letters of Latin-1, which NFC leaves alone. Runs of such words alone are "plain".
_PLAIN = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[!-&(-/:-@\[-`{-~]+")
_RUNS = re.compile(r"[^\x20\x09-\x0D]+")
# What a byte of UTF-8 is: white space, part of a letter (0xC3 leads those of Latin-1), digit, mark, or in a plain run's way.
_BLANK, _LETTER, _DIGIT, _MARK, _OTHER = range(5)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[0x21:0x7F], _KIND[:0x20], _KIND[0x7F] = _MARK, _MARK, _OTHER
_KIND[[9, 10, 11, 12, 13, 32]] = _BLANK
_KIND[0x30:0x3A], _KIND[0x27] = _DIGIT, _OTHER
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = _KIND[0x80:0xC0] = _KIND[0xC3] = _LETTER
_KIND[[*range(9), *range(14, 32)]] = _OTHER
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 32


def cut_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(words of the plain runs, folded, and the other runs as they are, in order; how many each text has)."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    offsets = offsets - offsets[0]
    kind, folded = _KIND[data], _FOLD[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True  # the first byte of a text; the last place is one past the end
    first = first[:-1]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    after = data[lead + 1]
    kind[lead[(after == 0x97) | (after == 0xB7)]] = _OTHER  # the signs of multiplying and dividing
    folded[lead[(after < 0x9F) & (after != 0x97)] + 1] += 32
    odd = np.flatnonzero(kind == _OTHER)
    if len(odd):
        space = kind == _BLANK
        begins = ~space & first
        begins[1:] |= ~space[1:] & space[:-1]
        ends = np.zeros(len(data), bool)
        ends[:-1] = ~space[:-1] & (space[1:] | first[1:])
        ends[-1:] = ~space[-1:]
        begins, ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        run = np.unique(np.searchsorted(begins, odd, side="right") - 1)
        step = np.zeros(len(data) + 1, np.int8)
        step[begins[run]] += 1
        step[ends[run]] -= 1
        inside = np.cumsum(step[:-1], dtype=np.int8).view(bool)
        kind[inside] = _OTHER
        folded = np.where(inside, data, folded)
    start = first | (kind == _DIGIT)
    start[1:] |= kind[1:] != kind[:-1]
    keep = kind != _BLANK
    start = np.flatnonzero(start & keep)
    place = np.cumsum(keep, dtype=np.int32)
    bounds = np.append(place[start] - 1, place[-1:] if len(place) else 0).astype(np.int32)
    words = pa.StringArray.from_buffers(len(start), pa.py_buffer(bounds), pa.py_buffer(folded[keep]))
    return words, np.diff(np.searchsorted(start, offsets))


class RunTable:
    """Ids, as little-endian unsigned 16-bit integers, of words and of runs without ASCII white space, many at a time:
    neither the normaliser nor the splitter joins anything across such white space.

    words: ids of each of many plain words; others: ids of each of many runs that are not plain.
    Bounded: two generations of TABLE_ROWS; what the older one holds is taken over when it is met again.
    """

    def __init__(self, words: Callable[[list[str]], list[bytes]], others: Callable[[list[str]], list[bytes]]):
        self.encoders = words, others
        self.young: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def get(self, found: Sequence[str]) -> list[bytes]:
        """Ids of each of the distinct words and runs in `found`."""
        if len(self.young) >= TABLE_ROWS:
            self.young, self.older = {}, self.young
        out = list(map(self.young.get, found))
        unknown = [i for i, ids in enumerate(out) if ids is None]
        if self.older:
            for i, ids in zip(unknown, map(self.older.get, [found[i] for i in unknown]), strict=True):
                out[i] = ids
        new = [i for i in unknown if out[i] is None]
        plain = [_PLAIN.fullmatch(found[i]) is not None for i in new]
        for encode, wanted in zip(self.encoders, (True, False), strict=True):
            mine = [i for i, p in zip(new, plain, strict=True) if p == wanted]
            if mine:
                for i, ids in zip(mine, encode([found[i] for i in mine]), strict=True):
                    out[i] = ids
        self.young.update((w, out[i]) for i in unknown if len(w := found[i]) <= TABLE_CHARS)
        return out

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """(ids of the texts, where each text's end after a leading 0, texts left out for a run over RUN_CHARS)."""
        words, counts = cut_words(texts)
        coded = words.dictionary_encode()
        at, known = coded.indices.to_numpy(), coded.dictionary
        bounds = np.concatenate([[0], np.cumsum(counts)])
        found, left = known.to_numpy(zero_copy_only=False).tolist(), []
        long = np.flatnonzero(pc.binary_length(known).to_numpy() > RUN_CHARS)
        if len(long):
            left = np.unique(np.searchsorted(bounds, np.flatnonzero(np.isin(at, long)), side="right") - 1).tolist()
            for i in long.tolist():
                found[i] = "."
        ids = self.get(found)
        size = np.array([len(x) >> 1 for x in ids], np.int64)
        flat = np.frombuffer(b"".join(ids), "<u2")
        n = size[at]
        ends = np.concatenate([[0], np.cumsum(n)])
        # Each id's place in `flat`: where its word begins there, and how far into the word it is.
        place = np.repeat((np.cumsum(size) - size)[at] - ends[:-1], n)
        place += np.arange(ends[-1])
        return flat[place], ends[bounds], left


@cache
def _joining() -> frozenset[str]:
    """Letters that normalising can join to the character before them, beside marks."""
    made = (unicodedata.decomposition(chr(c)) for c in range(0x110000))
    pairs = (d.split() for d in made if d and d[0] != "<")
    return frozenset([chr(int(p[1], 16)) for p in pairs if len(p) == 2] + [chr(c) for c in range(0x1160, 0x1200)])


#: Where a contraction may be under way at the end of a text.
_CONTRACTION = re.compile(r"(?:^|[^'])'.{0,2}$", re.S)


def cut(text: str) -> int:
    """The last place where a run may be cut: normalising joins nothing across it, and no contraction is under way. 0 if none."""
    for i in range(len(text) - 1, 3, -1):
        c = text[i]
        alone = c.isascii() or (unicodedata.category(c)[0] in "LNPS" and not unicodedata.combining(c) and c not in _joining())
        if alone and not _CONTRACTION.search(text[i - 4:i]):
            return i
    return 0


class Stream:
    """Ids of a text that comes in pieces: feed() them, then finish(); each call returns the ids that became stable."""

    def __init__(self, encoder: Encoder):
        self.encoder, self.text = encoder, ""
        self.word, self.mark = OpenWord(encoder.merges), ""  # mark: a character of the open word's class, if there is one

    def feed(self, piece: str) -> np.ndarray:
        e, self.text, out = self.encoder, self.text + piece, array("H")
        for m in list(e.special.finditer(self.text)) if e.special else ():
            at = len(self.text) - len(m.string) + m.start()
            self._closed(self.text[:at], out)
            out.append(e.merges.special[m[0]])
            self.text = self.text[at + len(m[0]):]
        # The beginning of a special string waits for its end.
        free = len(self.text) - max((k for s in e.merges.special for k in range(1, len(s)) if self.text.endswith(s[:k])), default=0)
        blank = max(self.text.rfind(c, 0, free) for c in " \t\n\x0b\x0c\r") + 1
        if blank:
            self._closed(self.text[:blank], out)
        while free - blank > RUN_CHARS and (at := cut(self.text[blank:min(free, blank + RUN_CHARS)]) or cut(self.text[blank:free])):
            self._part(self.text[blank:blank + at], out)
            blank += at
        self.text = self.text[blank:]
        return np.frombuffer(out.tobytes(), "<u2")

    def finish(self) -> np.ndarray:
        out = array("H")
        self._closed(self.text, out)
        self.text = ""
        return np.frombuffer(out.tobytes(), "<u2")

    def _closed(self, text: str, out: array) -> None:
        """Text whose last run ends here."""
        if self.mark and (not text or _RUNS.match(text) is None):
            self._close(out)
        found = _RUNS.findall(text)
        first = 0
        if self.mark:
            self._long(found[0], out)
            first = 1
        short: list[str] = []
        for run in [*found[first:], ""]:
            if run and len(run) <= RUN_CHARS:
                short.append(run)
                continue
            words = cut_words(pa.array([" ".join(short)], pa.string()))[0].to_pylist()
            distinct = list(dict.fromkeys(words))
            known = dict(zip(distinct, self.encoder.table.get(distinct), strict=True))
            out.frombytes(b"".join(map(known.__getitem__, words)))
            short = []
            if run:
                self._long(run, out)

    def _long(self, run: str, out: array) -> None:
        while len(run) > RUN_CHARS and (at := cut(run[:RUN_CHARS]) or cut(run)):
            self._part(run[:at], out)
            run = run[at:]
        self._part(run, out)
        self._close(out)

    def _close(self, out: array) -> None:
        out.extend(self.word.finish())
        self.mark = ""

    def _part(self, text: str, out: array) -> None:
        """Part of a run: all its words but the last one end here, which stays open unless it is a digit."""
        e = self.encoder
        normal = e.normalize(text)
        parts = e.split(self.mark + normal)
        if self.mark:
            out.extend(self.word.feed(e.bytes_of(parts[0])[1:]))
            parts = parts[1:]
            if parts:
                self._close(out)
        for p in parts[:-1]:
            out.extend(e.merges.transduce(e.bytes_of(p)))
        if parts:
            out.extend(self.word.feed(e.bytes_of(parts[-1])))
        # A blank of Unicode's leaves the mark's character as the only word, which is then shorter.
        self.mark = next((c for c in "a!" if [e.bytes_of(w) for w in e.split(c + normal[-1:])] == [(c + normal[-1:]).encode()]), "") if normal else ""
        if not self.mark:
            self._close(out)


class Encoder:
    """Texts to ids: the file's normaliser and splitter, and the merges of this module."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.merges = merge_list(path)
        library = Tokenizer.from_file(path)
        self.normalize, splitter = library.normalizer.normalize_str, library.pre_tokenizer
        self.split = lambda text: [w for w, _ in splitter.pre_tokenize_str(text)]
        self.back = {ord(c): b for b, c in enumerate(byte_alphabet())}
        self.special = re.compile("|".join(map(re.escape, self.merges.special))) if self.merges.special else None
        self.table = RunTable(self._words, self._others)

    def bytes_of(self, word: str) -> bytes:
        """What the splitter's word, in the byte alphabet, stands for."""
        return word.translate(self.back).encode("latin-1")

    def _words(self, words: list[str]) -> list[bytes]:
        return [array("H", self.merges.word(w.encode())).tobytes() for w in words]

    def _others(self, runs: list[str]) -> list[bytes]:
        out = []
        for run in runs:
            ids = array("H")
            for w in self.split(self.normalize(run)):
                ids.extend(self.merges.word(self.bytes_of(w)))
            out.append(ids.tobytes())
        return out

    def stream(self) -> Stream:
        return Stream(self)

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of one text, through a stream."""
        s, text = self.stream(), text or ""
        return np.concatenate([*(s.feed(text[i:i + PIECE]) for i in range(0, len(text), PIECE)), s.finish()])

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many texts, and where each text's end after a leading 0."""
        return encoded(self.table, texts, self.special, self.encode)


def encoded(table: RunTable, texts: pa.Array, special: re.Pattern | None, alone: Callable[[str], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of many texts and where each text's end after a leading 0; texts with special strings or long runs go through `alone`."""
    texts = pc.fill_null(texts, "")
    odd = pc.match_substring_regex(texts, special.pattern).to_numpy(zero_copy_only=False) if special else np.zeros(len(texts), bool)
    ids, ends, left = table.batch(pc.if_else(pa.array(odd), "", texts) if odd.any() else texts)
    apart = sorted({*np.flatnonzero(odd).tolist(), *left})
    if not apart:
        return ids, ends
    parts = np.split(ids, ends[1:-1])
    for i in apart:
        parts[i] = alone(texts[i].as_py())
    return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


class Decoder:
    """feed() ids piece by piece, then finish(); each call returns the text that became complete."""

    BLOCK = 1 << 14

    def __init__(self, path: str, pieces: bool = True):
        """pieces: the tokens' strings with single spaces between; else the bytes they stand for, a space after each word."""
        m, back = merge_list(path), {c: bytes([b]) for b, c in enumerate(byte_alphabet())}
        if pieces:
            self.table = [b" " + t.encode() for t in m.tokens]
        else:
            plain = [(t[:-len(END)], b" ") if t.endswith(END) and len(t) > len(END) else (t, b"") for t in m.tokens]
            self.table = [t.encode() if t in m.special else b"".join(back.get(c, c.encode()) for c in t) + e for t, e in plain]
        self.pieces, self.fresh = pieces, True
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: np.ndarray) -> str:
        out = b"".join(map(self.table.__getitem__, ids.tolist()))
        if self.pieces and self.fresh and out:
            out = out[1:]
        self.fresh = self.fresh and not len(ids)
        return self.machine.decode(out)

    def finish(self) -> str:
        out, self.fresh = self.machine.decode(b"", True), True
        self.machine.reset()
        return out


def decode(decoder: Decoder, ids: np.ndarray) -> Iterator[str]:
    for i in range(0, len(ids), decoder.BLOCK):
        yield decoder.feed(ids[i:i + decoder.BLOCK])
    yield decoder.finish()


@lru_cache(maxsize=1)
def _state(path: str) -> tuple[Encoder, Decoder, list[bytes]]:
    """Kept by a worker from task to task."""
    encoder = Encoder(path)
    return encoder, Decoder(path), [b" %d" % i for i in range(len(encoder.merges.tokens))]


def _digests(path: str, ids: np.ndarray) -> tuple[str, str]:
    """SHA-256 of the decimal ids joined by one space, and of the decoded text."""
    _, decoder, decimal = _state(path)
    seen, back = hashlib.sha256(), hashlib.sha256()
    for i in range(0, len(ids), decoder.BLOCK):
        part = b"".join(map(decimal.__getitem__, ids[i:i + decoder.BLOCK].tolist()))
        seen.update(part if i else part[1:])
    for part in decode(decoder, ids):
        back.update(part.encode())
    return seen.hexdigest(), back.hexdigest()


def tokenize(docs: DataFrame, path: str, keep: Iterable[str] = ("doc_id",), with_ids: bool = True, text: str = "text") -> DataFrame:
    """The columns `keep` of docs, with n_tokens, ids_sha256, decoded_sha256 and, if asked for, the ids; they replace kept columns of these names."""
    ship(docs.sparkSession)
    made = T._parse_datatype_string("n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else ""))
    keep = [c for c in keep if c not in made.names]
    kept = docs.select(*(docs[f"`{c}`"] for c in keep), docs[f"`{text}`"].alias("__text"))
    schema = T.StructType([*kept.schema.fields[:-1], *made.fields])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for b in slices(whole, len(keep)):
                ids, ends = _state(path)[0].batch(b.column(len(keep)))
                rows = [_digests(path, ids[i:j]) for i, j in zip(ends, ends[1:], strict=False)]
                cols = [*b.columns[:len(keep)], pa.array(np.diff(ends), pa.int64()), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return map_batches(kept, batches, schema)


@lru_cache(maxsize=1)
def _plain_decoder(path: str) -> Decoder:
    return Decoder(path, pieces=False)


def detokenize(rows: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """rows with `out`, the text that their ids stand for (one space after each word), by the byte-to-text machine; a column of
    this name is replaced, and null ids give a null text."""
    ship(rows.sparkSession)
    rows = rows.drop(out)
    place = rows.columns.index(ids)
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.StringType())])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            decoder = _plain_decoder(path)
            texts = [None if x is None else "".join(decode(decoder, np.array(x, np.int64))) for x in b.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=schema.names)

    return map_batches(rows, batches, schema)
