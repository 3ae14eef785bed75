"""Secret scans through a recursive decoding worklist.

A text is the first layer. Every layer is scanned for secrets and then unwrapped; new layers join the worklist
until there are none:

* percent escapes, and Unicode escapes, give the layer with all of them decoded; bytes that are no UTF-8 stand
  as lone surrogates, one each, so that nothing is lost and the bytes can be had back;
* a layer with NULs (UTF-16, UTF-32) gives the one without them;
* a run of base64 characters, one that is wrapped over lines included, gives the four layers of its four
  alignments, so that what stands before the base64 and looks like it (a path, a name) does no harm;
* where a gzip, zlib, bzip2 or xz stream starts, at any place of a layer, it is decompressed. That is streamed:
  each piece of `PIECE` bytes, with the `OVERLAP` characters before it, is a layer of its own, and an output that
  is a stream again goes through the next decompressor as it comes. Members that follow one another are one
  stream; one that is cut short gives what there is.

A layer whose content was already met at the same place is not taken up again, and a stream whose start was met
on the way to it is not opened again, which ends cycles (a stream that decompresses to itself, in any number of
steps). What grows without end is left when `MAX_DEPTH` streams are open in one another, or when the layers of a
document have `MAX_DECODED` characters; `complete` is false then, and the rest of that document's spans stay.

Each layer maps its spans to its parent, and so on down to the text: escapes map exactly, base64 to the groups
of four characters that the span's bytes came from, all in a compressed stream to the whole of it.

Python functions over Arrow batches: state is one document, nothing is shuffled, and a lost executor
costs its own tasks only.

Defined results: a null text counts as empty; an empty text has no spans and the hash of the empty
string; every row gives one row, repeated rows and null ids included; equal spans of a kind (found in
several layers) count once; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import binascii
import bisect
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from crossgrain.llm.text import pieces
from crossgrain.sources.tables import table

KINDS = ("assign", "access", "hex")
_ORDER = {k: i for i, k in enumerate(KINDS)}
MIN_VALUE, MIN_ACCESS, MIN_HEX, MIN_BASE64 = 8, 16, 32, 16
#: Characters of the shortest secret; a shorter layer has none.
MIN_SECRET = 14
#: Bytes of a stream's output that are scanned at a time, and the characters that pieces share.
PIECE, OVERLAP = 1 << 20, 1 << 12
#: Bytes by which a stream is known again, and those that are fed to a decompressor at a time.
HEAD, FEED = 1 << 16, 1 << 14
MAX_DEPTH, MAX_DECODED = 64, 1 << 27

_ASSIGN = re.compile(
    r"""(?:[pP][aA][sS][sS](?:[wW][oO][rR][dD]|[wW][dD])|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(
    r"\\u([dD][89abAB][0-9A-Fa-f]{2})\\u([dD][c-fC-F][0-9A-Fa-f]{2})|\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#[xX]([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});"
)
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{4,}+(?:[ \t]*\r?\n[ \t>]*[A-Za-z0-9+/_-]{2,}+)+={0,2}")
_NULS = re.compile("\0+")
_URL_SAFE = str.maketrans("-_", "+/")
_STREAM = re.compile("\x1f[\x8b\udc8b]\x08|BZh[1-9](?:1AY&SY|\x17rE8P)|[\xfd\udcfd]7zXZ\x00|x[\x01^\x9c\xda\udc9c\udcda]")
_BYTES = re.compile("[\x00-\xff]*")

Span = tuple[str, int, int]


def base_spans(text: str) -> Iterator[Span]:
    """The secrets that stand in `text` itself, (kind, start, end) in code points."""
    for m in _ASSIGN.finditer(text):
        if m.end(1) - m.start(1) >= MIN_VALUE:
            yield "assign", m.start(), m.end()
    if "AKIA" in text:
        for m in _ACCESS.finditer(text):
            yield "access", m.start(), m.end()
    for m in _HEX.finditer(text):
        yield "hex", m.start(), m.end()


class Layer:
    """`text`, whose spans `up` maps to the parent's; streams are looked for from `streams` on."""

    def __init__(self, text: str, parent: Layer | None = None, streams: int = 0):
        self.text, self.parent, self.streams = text, parent, streams

    def up(self, start: int, end: int) -> tuple[int, int]:
        raise NotImplementedError

    def root_span(self, start: int, end: int) -> tuple[int, int]:
        layer = self
        while layer.parent is not None:
            start, end = layer.up(start, end)
            layer = layer.parent
        return start, end


class Replaced(Layer):
    """`cuts` are the starts of pieces, each copied from `sources[i]` or, if `blocks[i]` is set, standing as a whole for that many characters there."""

    def __init__(self, parent: Layer):
        super().__init__("", parent)
        self.cuts: list[int] = []
        self.sources: list[int] = []
        self.blocks: list[int] = []

    def up(self, start: int, end: int) -> tuple[int, int]:
        i, j = bisect.bisect_right(self.cuts, start) - 1, bisect.bisect_right(self.cuts, end - 1) - 1
        return (
            self.sources[i] + (0 if self.blocks[i] else start - self.cuts[i]),
            self.sources[j] + (self.blocks[j] or end - self.cuts[j]),
        )


class Unpacked(Layer):
    """The bytes of base64 whose lines start at `starts` of the parent and at `offsets` of the base64 put together, from its character `skip` on."""

    def __init__(self, text: str, parent: Layer, starts: list[int], offsets: list[int], skip: int, size: int):
        super().__init__(text, parent)
        self.starts, self.offsets, self.skip, self.size = starts, offsets, skip, size

    def _at(self, k: int) -> int:
        line = bisect.bisect_right(self.offsets, k) - 1
        return self.starts[line] + k - self.offsets[line]

    def up(self, start: int, end: int) -> tuple[int, int]:
        first = len(_as_bytes(self.text[:start]))
        last = first + len(_as_bytes(self.text[start:end])) - 1
        return self._at(self.skip + first // 3 * 4), self._at(min(self.skip + last // 3 * 4 + 3, self.size - 1)) + 1


def _as_bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogateescape")


def _as_text(data: bytes) -> str:
    return data.decode("utf-8", "surrogateescape")


def _replaced(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The layer with every match that `decode` gives (source start, length, text) pieces for replaced; None if there is none."""
    out, new, at, size, changed = [], Replaced(layer), 0, 0, False

    def add(piece: str, source: int, block: int) -> None:
        nonlocal size
        if piece:
            out.append(piece)
            new.cuts.append(size)
            new.sources.append(source)
            new.blocks.append(block)
            size += len(piece)

    for m in pattern.finditer(layer.text):
        if found := decode(m):
            changed = True
            add(layer.text[at : m.start()], at, 0)
            for source, length, piece in found:
                add(piece, source, length)
            at = m.end()
    if not changed:
        return None
    add(layer.text[at:], at, 0)
    new.text = "".join(out)
    return new


def _percent(m: re.Match) -> list[tuple[int, int, str]]:
    found, at = [], m.start()
    for c in _as_text(bytes.fromhex(m[0].replace("%", ""))):
        size = 3 * len(_as_bytes(c))
        found.append((at, size, c))
        at += size
    return found


def _unicode(m: re.Match) -> list[tuple[int, int, str]]:
    high, low, *codes, decimal = m.groups()
    if high:
        code = 0x10000 + ((int(high, 16) - 0xD800) << 10) + int(low, 16) - 0xDC00
    else:
        code = int(decimal) if decimal else int(next(filter(None, codes)), 16)
    if 0xD800 <= code < 0xE000 or code > 0x10FFFF:
        return []
    return [(m.start(), m.end() - m.start(), chr(code))]


def _base64_layers(layer: Layer) -> Iterator[Layer]:
    lines = [[(m.start(), m[0].rstrip("="))] for m in _BASE64.finditer(layer.text)]
    if "\n" in layer.text:
        for m in _WRAPPED.finditer(layer.text):
            lines.append([(m.start() + x.start(), x[0]) for x in re.finditer(r"[A-Za-z0-9+/_-]+", m[0])])
    for token in lines:
        body = "".join(x for _, x in token).translate(_URL_SAFE)
        if len(body) < MIN_BASE64:
            continue
        starts, offsets, at = [], [], 0
        for start, x in token:
            starts.append(start)
            offsets.append(at)
            at += len(x)
        for skip in range(4):
            n = len(body) - skip
            n -= n % 4 == 1
            data = binascii.a2b_base64(body[skip : skip + n] + "=" * (-n % 4))
            if len(data) >= MIN_SECRET:
                yield Unpacked(_as_text(data), layer, starts, offsets, skip, len(body))


class Decompressor:
    """The bytes that a stream of any known kind, member after member, holds."""

    def __init__(self):
        self.one, self.done, self.held, self.used, self.given = None, False, b"", 0, 0

    @staticmethod
    def kind(head: bytes):
        if head[:3] == b"\x1f\x8b\x08":
            return zlib.decompressobj(31)
        if head[:1] == b"\x78" and len(head) > 2 and (head[0] * 256 + head[1]) % 31 == 0:
            return zlib.decompressobj()
        if head[:3] == b"BZh":
            return bz2.BZ2Decompressor()
        if head[:6] == b"\xfd7zXZ\x00":
            return lzma.LZMADecompressor(lzma.FORMAT_XZ)
        return None

    def feed(self, data: bytes) -> Iterator[bytes]:
        """What comes of `data`, at most PIECE bytes at a time."""
        self.held += data
        while not self.done and self.held:
            if self.one is None:
                if len(self.held) < 6:
                    return
                self.one = self.kind(self.held)
                if self.one is None:
                    self.done = True
                    return
            before = len(self.held)
            try:
                out = self.one.decompress(self.held, PIECE)
            except (zlib.error, OSError, ValueError, lzma.LZMAError, EOFError):
                self.done = True
                return
            if self.one.eof:
                self.held, self.one = self.one.unused_data, None
            else:
                self.held = getattr(self.one, "unconsumed_tail", b"")
            self.used += before - len(self.held)
            self.given += len(out)
            if out:
                yield out
            if self.one is not None and not self.held:
                while not getattr(self.one, "needs_input", True) and not self.one.eof:  # bzip2 and xz keep what they have not read
                    try:
                        out = self.one.decompress(b"", PIECE)
                    except (OSError, ValueError, lzma.LZMAError, EOFError):
                        self.done = True
                        return
                    self.given += len(out)
                    if out:
                        yield out
                if self.one.eof:
                    self.held, self.one = self.one.unused_data, None
                    self.used -= len(self.held)


@dataclass
class Budget:
    """Characters that the layers of a document may still have."""

    left: int = MAX_DECODED
    complete: bool = True

    def take(self, n: int) -> bool:
        if self.left < n:
            self.complete = False
            return False
        self.left -= n
        return True


class Stage:
    """A decompressor, the pieces of whose output are scanned, and the one that takes the output if that is a stream again."""

    def __init__(self, budget: Budget, met: frozenset[bytes], depth: int):
        self.decompressor, self.budget, self.met, self.depth = Decompressor(), budget, met, depth
        self.kinds: set[str] = set()
        self.scanned: set[bytes] = set()
        self.before, self.head, self.inner, self.undecided, self.first = "", b"", None, True, b""

    def feed(self, data: bytes) -> None:
        for out in self.decompressor.feed(data):
            key = _digest(self.before.encode("utf-8", "surrogatepass") + out)
            new = key not in self.scanned and len(self.kinds) < len(KINDS)
            if not self.budget.take(len(out) if new else len(out) // 16):
                self.decompressor.done = True
                return
            text = self.before + _as_text(out)
            inner = self.inner.decompressor.given and not self.inner.decompressor.done if self.inner else self.undecided and Decompressor.kind(self.head or out)
            if new:  # where a stream stands, the inner stage has it, and what follows it is left to `finish`
                self.scanned.add(key)
                self.kinds |= {k for k, _, _ in _spans(Layer(text, streams=len(text) if inner else 0), self.budget, self.met, self.depth)}
            if inner and not self.before:
                self.first = out
            self.before = text[-OVERLAP:]
            if self.undecided:
                self.head += out
                if len(self.head) >= HEAD:
                    self._decide()
            elif self.inner:
                self.inner.feed(out)

    def _decide(self) -> None:
        self.undecided = False
        key = _digest(self.head[:HEAD])
        if Decompressor.kind(self.head) is not None and key not in self.met:
            if self.depth >= MAX_DEPTH:
                self.budget.complete = False
            else:
                self.inner = Stage(self.budget, self.met | {key}, self.depth + 1)
                self.inner.feed(self.head)
        self.head = b""

    def finish(self) -> set[str]:
        if self.undecided:
            self._decide()
        if self.inner:
            self.kinds |= self.inner.finish()
        used = self.inner.decompressor.used if self.inner and self.inner.decompressor.given else 1
        if used < len(self.first) and len(self.kinds) < len(KINDS):
            layer = Layer(_as_text(self.first), streams=len(_as_text(self.first[:used])))
            self.kinds |= {k for k, _, _ in _spans(layer, self.budget, self.met, self.depth)}
        return self.kinds


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _stream(text: str, start: int, budget: Budget, met: frozenset[bytes], depth: int) -> tuple[set[str], int] | None:
    """The kinds of secrets in the stream that starts at `start` of `text`, and where it ends; None if there is none."""
    stop, encode = (len(text), _as_bytes) if text[start + 1] > "\xff" or text[start] > "\xff" else (_BYTES.match(text, start).end(), lambda t: t.encode("latin-1"))
    if text[start] in "Bx" and not text[start + 1 : start + 2] > "\xff":  # as ASCII both may be meant: as Latin-1 only if no byte stands as a surrogate
        near = text[start : start + 64]
        if any("\udc80" <= c <= "\udcff" for c in near) or not any("\x80" <= c <= "\xff" for c in near):
            stop, encode = len(text), _as_bytes
    key = _digest(encode(text[start : min(stop, start + HEAD)])[:HEAD])
    if key in met:
        return None
    if depth >= MAX_DEPTH:
        budget.complete = False
        return None
    stage = Stage(budget, met | {key}, depth + 1)
    for at in range(start, stop, FEED):
        stage.feed(encode(text[at : min(at + FEED, stop)]))
        if stage.decompressor.done:
            break
    if not stage.decompressor.given:
        return None
    kinds, end, left = stage.finish(), start, stage.decompressor.used
    while left > 0 and end < stop:  # back from bytes to characters
        data = encode(text[end : min(end + FEED, stop)])
        step = min(FEED, stop - end) if len(data) <= left else len(data[:left].decode("latin-1") if encode is not _as_bytes else _as_text(data[:left]))
        left -= len(data)
        end += step
    return kinds, end


def unwrapped(layer: Layer) -> Iterator[Layer]:
    """The layers that stand directly within `layer`, less its streams."""
    text = layer.text
    if "%" in text and (new := _replaced(layer, _PERCENT, _percent)):
        yield new
    if ("\\" in text or "&#" in text) and (new := _replaced(layer, _UNICODE, _unicode)):
        yield new
    if "\0" in text and (new := _replaced(layer, _NULS, lambda m: [(m.start(), len(m[0]), "")])):
        new.streams = len(new.text)  # a stream without its NULs is none
        yield new
    yield from _base64_layers(layer)


def _spans(root: Layer, budget: Budget, met: frozenset[bytes], depth: int) -> set[Span]:
    """The spans of secrets in `root` and every layer within it."""
    found: set[Span] = set()
    work, seen = [root], set()
    while work:
        layer = work.pop()
        for kind, start, end in base_spans(layer.text):
            found.add((kind, *layer.root_span(start, end)))
        at = layer.streams
        while m := _STREAM.search(layer.text, at):
            at = m.start() + 1
            if got := _stream(layer.text, m.start(), budget, met, depth):
                kinds, end = got
                found.update((kind, *layer.root_span(m.start(), end)) for kind in kinds)
                at = max(at, end)
        for new in unwrapped(layer):
            if len(new.text) < MIN_SECRET or not budget.take(len(new.text)):
                continue
            key = (_digest(new.text.encode("utf-8", "surrogatepass")), *new.root_span(0, len(new.text)))
            if key not in seen:
                seen.add(key)
                work.append(new)
    return found


def scan(text: str) -> tuple[list[Span], bool]:
    """Secrets of `text` and of every layer within it, by start, kind and end, each span of the text once; and whether every layer was opened."""
    budget = Budget()
    return in_order(_spans(Layer(text), budget, frozenset(), 0)), budget.complete


def all_spans(text: str) -> list[Span]:
    return scan(text)[0]


def in_order(spans) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], _ORDER[s[0]], s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redacted(text: str, spans: list[Span], mark: str = "[SECRET]") -> str:
    """`text` with what the spans cover, overlapping ones together, replaced by `mark`."""
    out, at = [], 0
    for _, start, end in sorted(spans, key=lambda s: (s[1], s[2])):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]


def scan_secrets(docs: DataFrame) -> DataFrame:
    """For each row of `docs` (doc_id, text): doc_id, counts of base spans, base_sha256, spans, and whether every layer was opened."""

    def scanned(batches):
        import pyarrow as pa

        for b in pieces(batches, "text"):
            base, every, complete = [], [], []
            for text in b.column("text").to_pylist():
                base.append(in_order(base_spans(text or "")))
                spans, whole = scan(text or "")
                every.append(joined(spans))
                complete.append(whole)
            counts = [pa.array([sum(s[0] == kind for s in spans) for spans in base], pa.int64()) for kind in KINDS]
            hashes = pa.array([hashlib.sha256(joined(spans).encode()).hexdigest() for spans in base], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *counts, hashes, pa.array(every, pa.string()), pa.array(complete)], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "complete"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(scanned, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, complete boolean")


def redact_secrets(docs: DataFrame) -> DataFrame:
    """`docs` with all spans of `text` replaced by a mark, and `n_chars`, if there is one, as it is then; a null text stays null."""

    def cleaned(batches):
        import pyarrow as pa

        for b in pieces(batches, "text"):
            texts = [None if t is None else redacted(t, all_spans(t)) for t in b.column("text").to_pylist()]
            new = {"text": pa.array(texts, b.schema.field("text").type), "n_chars": pa.array([None if t is None else len(t) for t in texts], pa.int64())}
            yield pa.RecordBatch.from_arrays([new[f.name].cast(f.type) if f.name in new else b.column(i) for i, f in enumerate(b.schema)], schema=b.schema)
    return docs.mapInArrow(cleaned, docs.schema)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and decoded secrets of every document."""
    return scan_secrets(table(spark, sf_dir, "documents"))


QUERIES = {"op3_secret_scan": op3_secret_scan}
