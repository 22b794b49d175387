"""Secret scans through nested encodings (operator 1).

Every text is scanned as it stands (the base) and then unwrapped: a worklist
holds layers still to be unwrapped, each with the span of the original text
that every one of its characters comes from. Per-cent and Unicode escapes are
replaced in place; base64 runs, and compressed data within them, become layers
of their own. Each layer is scanned and unwrapped in turn until nothing new
appears. A layer whose content and origin were seen before is not taken up
again, so that data which decode to themselves end. Layers are made one at a
time; what compressed data hold is read in windows that overlap, all with the
span of the packed data, so that memory does not grow with it.
"""

from __future__ import annotations

import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexdrift.llm.common import each_text, handed_back, text_of, tune

# The kinds in their order, with the patterns of each.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_VALUE, LEAST_ACCESS = 6, 20

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2})+")
ONE_ESCAPE = re.compile(r"\\[uUx]\{?([0-9A-Fa-f]+)\}?")
#: Runs of base64, over line breaks (as in MIME, or escaped) too; possessive, so that long runs are read once. What is looked ahead for passes over most words.
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]{16}|[A-Za-z0-9+/_-]++(?:[\x20\t]*+\r?\n|(?:\\r)?\\n))[A-Za-z0-9+/_-]++(?:(?:[\x20\t]*+\r?\n[\x20\t]*+|(?:\\r)?\\n)[A-Za-z0-9+/_-]++)*+={0,2}")
BREAKS = re.compile(r"[\x20\t]*\r?\n[\x20\t]*|(?:\\r)?\\n")
LEAST_BASE64 = 16
#: Bytes that are no text (as read with surrogateescape), and the shortest text that can hold a secret.
NO_TEXT = re.compile("[\x00-\x08\x0e-\x1f\x7f\udc80-\udcff]")
HAS_TEXT = re.compile("[^\x00-\x08\x0e-\x1f\x7f\udc80-\udcff]{12}")
PACKED = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9]|\x28\xb5\x2f\xfd|\xfd7zXZ\x00")
#: Breaks and the end of a base64 run in bytes, and what may be the beginning of a break.
BYTE_BREAKS, NO_BASE64, OPEN_BREAK = re.compile(rb"[\x20\t]*\r?\n[\x20\t]*|(?:\\r)?\\n"), re.compile(rb"[^A-Za-z0-9+/_-]"), re.compile(rb"(?:[\x20\t\r\n]|\\r?)*\Z")
#: What xz data may ask for to be read.
MOST_DICTIONARY = 128 << 20

SPANS = "doc_id long, n_assign long, n_access long, n_hex long, base string, spans string, n_added long, n_layers long, n_cut long"


@dataclass
class Layer:
    """Decoded text; ``start`` and ``end`` give each character's span in the original (None: the original itself).

    ``span`` is that of all characters of a window of inflated data, ``raw`` its
    bytes, and ``after`` reads what follows them (None: nothing does).
    """

    text: str
    start: np.ndarray | None = None
    end: np.ndarray | None = None
    span: tuple[int, int] | None = None
    raw: bytes = b""
    after: Callable[[], Iterator[bytes]] | None = None

    def origin(self, a: int, b: int) -> tuple[int, int]:
        if self.span is not None:
            return self.span
        return (a, b) if self.start is None else (int(self.start[a]), int(self.end[b - 1]))

    def starts(self, a: int, b: int) -> np.ndarray:
        if self.span is not None:
            return np.full(b - a, self.span[0])
        return np.arange(a, b) if self.start is None else self.start[a:b]

    def ends(self, a: int, b: int) -> np.ndarray:
        if self.span is not None:
            return np.full(b - a, self.span[1])
        return np.arange(a + 1, b + 1) if self.end is None else self.end[a:b]


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the secrets in one text, leftmost and non-overlapping for each kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{a}:{b}" for a, kind, b in spans)


def _replaced(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """Replace each match by what ``decode`` gives: [(character, from, to)] relative to the match, or None to leave it."""
    parts, starts, ends, at, changed = [], [], [], 0, False

    def keep(a: int, b: int) -> None:
        parts.append(layer.text[a:b])
        starts.append(layer.starts(a, b))
        ends.append(layer.ends(a, b))

    for m in pattern.finditer(layer.text):
        got = decode(m[0])
        if got is None:
            continue
        keep(at, m.start())
        at, changed = m.end(), True
        origins = [layer.origin(m.start() + a, m.start() + b) for _, a, b in got]
        parts.append("".join(c for c, _, _ in got))
        starts.append(np.array([a for a, _ in origins], "i8"))
        ends.append(np.array([b for _, b in origins], "i8"))
    if not changed:
        return None
    keep(at, len(layer.text))
    return Layer("".join(parts), np.concatenate(starts), np.concatenate(ends))


def _percent(run: str) -> list[tuple[str, int, int]]:
    """Bytes that are not UTF-8 become replacement characters."""
    out, at = [], 0
    for c in bytes.fromhex(run.replace("%", "")).decode("utf-8", "surrogateescape"):
        n = 3 * len(c.encode("utf-8", "surrogateescape"))
        out.append(("\ufffd" if "\ud800" <= c < "\ue000" else c, at, at + n))
        at += n
    return out


def _percent_bytes(run: str) -> list[tuple[str, int, int]]:
    """One character a byte."""
    return [(chr(x), 3 * k, 3 * k + 3) for k, x in enumerate(bytes.fromhex(run.replace("%", "")))]


def _escapes(run: str) -> list[tuple[str, int, int]]:
    out: list[tuple[str, int, int]] = []
    for m in ONE_ESCAPE.finditer(run):
        code = int(m[1], 16)
        if 0xDC00 <= code < 0xE000 and out and 0xD800 <= ord(out[-1][0]) < 0xDC00:
            high = out.pop()
            out.append((chr(0x10000 + (ord(high[0]) - 0xD800 << 10) + code - 0xDC00), high[1], m.end()))
        else:
            code = 0xFFFD if code > 0x10FFFF else code
            out.append((chr(code), m.start(), m.end()))
    return [("\ufffd" if 0xD800 <= ord(c) < 0xE000 else c, a, b) for c, a, b in out]


#: Inflated data are read in windows of so many bytes, of which each repeats the end of the one before.
WINDOW, OVERLAP, CHUNK = 1 << 20, 1 << 14, 1 << 18


class Inflater:
    """Inflates gzip, zlib, bzip2, xz or zstd data, with all members, from chunks that ``source`` yields.

    Damaged gzip data are read up to the damage, thus whole where only the
    checksum is wrong. Other formats give the blocks before it; two bytes that
    look like zlib's head are too often chance for more.
    """

    def __init__(self, source: Iterator[bytes]):
        self.source, self.read, self.ended, self.starved = source, 0, False, False

    def _machine(self, head: bytes):
        if head[:1] in (b"\x1f", b"\x78"):
            return zlib.decompressobj(47)
        if head[:1] == b"\xfd":
            return lzma.LZMADecompressor(lzma.FORMAT_XZ, MOST_DICTIONARY)
        return bz2.BZ2Decompressor() if head[:3] == b"BZh" else zstandard.ZstdDecompressor().decompressobj()

    def rescued(self, machine, data: bytes) -> Iterator[bytes]:
        """What comes out before the byte at which ``machine`` fails."""
        out, size = [], 0
        for k in range(len(data)):
            try:
                part = machine.decompress(data[k : k + 1])
            except zlib.error:
                break
            self.read += 1
            out.append(part)
            size += len(part)
            if size >= CHUNK:
                yield b"".join(out)
                out, size = [], 0
        # Chance brings forth a few bytes; no secret is that short.
        if len(rest := b"".join(out)) >= 12:
            yield rest

    def chunks(self) -> Iterator[bytes]:
        """Content in chunks; afterwards ``read`` bytes were taken, and ``starved`` tells that more input would go on."""
        data, machine, kind = b"", None, b""
        while True:
            if not data:
                data = next(self.source, b"")
                if not data:
                    self.starved = machine is not None
                    return
            if machine is None:
                while len(data) < 4 and (more := next(self.source, b"")):
                    data += more
                if kind and (data[:3] != kind or kind[:1] == b"\x78"):
                    return
                kind, machine = data[:3], self._machine(data)
            try:
                if kind[:1] in (b"\x1f", b"\x78"):
                    feed = data
                    while True:
                        before = machine.copy()
                        try:
                            part = machine.decompress(feed, CHUNK)
                        except zlib.error:
                            self.read += len(data) - len(feed)
                            if kind[:1] == b"\x1f":
                                yield from self.rescued(before, feed)
                            return
                        if not machine.unconsumed_tail:
                            break
                        yield part
                        feed = machine.unconsumed_tail
                elif isinstance(machine, bz2.BZ2Decompressor | lzma.LZMADecompressor):
                    part = machine.decompress(data, CHUNK)
                    while part and not machine.eof and not machine.needs_input:
                        yield part
                        part = machine.decompress(b"", CHUNK)
                else:
                    part = machine.decompress(data)
            except (zlib.error, lzma.LZMAError, OSError, EOFError, ValueError, zstandard.ZstdError):
                return
            if part:
                yield part
            rest = machine.unused_data if machine.eof else b""
            self.read += len(data) - len(rest)
            data = rest
            if machine.eof:
                machine = None


def pieces(data: bytes, size: int = 1 << 14) -> Iterator[bytes]:
    """``data`` in small pieces, so that an inflater puts out little at a time."""
    return (data[k : k + size] for k in range(0, len(data), size))


def skipped(source: Iterator[bytes], n: int) -> Iterator[bytes]:
    for data in source:
        if n < len(data):
            yield data[n:]
        n = max(0, n - len(data))


def unpacked_letters(rest: str, after: Callable[[], Iterator[bytes]]) -> Iterator[bytes]:
    """The bytes that a base64 run stands for whose letters ``rest`` are followed by those of ``after``, up to the run's end."""
    held, letters = b"", rest.encode()
    for data in after():
        data = held + data
        keep = OPEN_BREAK.search(data).start()
        data, held = BYTE_BREAKS.sub(b"", data[:keep]), data[keep:]
        end = NO_BASE64.search(data)
        letters += data[: end.start()] if end else data
        full = len(letters) // 4 * 4
        if full:
            yield binascii.a2b_base64(letters[:full].translate(STANDARD))
        letters = letters[full:]
        if end:
            break
    if len(letters) > 1:
        yield binascii.a2b_base64(letters.translate(STANDARD) + b"=" * (-len(letters) % 4))


STANDARD = bytes.maketrans(b"-_", b"+/")


class Cut:
    """What is left of the bytes that inflated data may come to, and how often it ran out."""

    def __init__(self, most_bytes: int | None):
        self.most, self.count = most_bytes, 0


def _windows(open_source: Callable[[], Iterator[bytes]], span: tuple[int, int], inflater: Inflater, limits: Cut) -> Iterator[Layer]:
    """Layers of the windows of what ``inflater`` puts out; ``open_source`` begins to read the packed data anew."""
    held, at, total = bytearray(), 0, 0
    for part in inflater.chunks():
        total += len(part)
        if limits.most is not None and total > limits.most:
            limits.count += 1
            held += part[: len(part) - (total - limits.most)]
            break
        held += part
        while len(held) > WINDOW:
            stop = at + WINDOW
            yield _window(bytes(held[:WINDOW]), span, lambda stop=stop: skipped(Inflater(open_source()).chunks(), stop))
            del held[: WINDOW - OVERLAP]
            at += WINDOW - OVERLAP
    if held and (not at or len(held) > OVERLAP):
        yield _window(bytes(held), span, None)


def _window(raw: bytes, span: tuple[int, int], after) -> Layer:
    return Layer(NO_TEXT.sub("\ufffd", raw.decode("utf-8", "surrogateescape")), span=span, raw=raw, after=after)


def _packed_layers(data: bytes, origin, limits: Cut, after=None) -> Iterator[Layer]:
    """Layers of compressed data anywhere in ``data``; ``origin`` gives the span of a stretch of its bytes, ``after`` reads what follows them."""
    at = 0
    while (m := PACKED.search(data, at)) is not None:
        begin, view = m.start(), data

        def source(begin=begin) -> Iterator[bytes]:
            yield from pieces(view[begin:])
            if after is not None:
                yield from after()

        trial = Inflater(pieces(data[begin:]))
        shows = next(trial.chunks(), b"")
        if not shows:
            at = begin + 1
            continue
        inflater = Inflater(source())
        # The end is known once all is read; until then the span is that of the rest of the data.
        size = packed_size(data, begin)
        yield from _windows(source, origin(begin, begin + size), inflater, limits)
        at = begin + size


def packed_size(data: bytes, begin: int) -> int:
    """How many bytes of ``data`` the compressed data from ``begin`` on take."""
    inflater = Inflater(pieces(data[begin:]))
    for _ in inflater.chunks():
        pass
    return max(1, min(inflater.read, len(data) - begin) if not inflater.starved else len(data) - begin)


def _base64_layers(layer: Layer, limits: Cut) -> Iterator[Layer]:
    """A run may begin amid other letters, so it is read from each of four places on; bytes that are no text stand between texts."""
    for m in BASE64.finditer(layer.text):
        if m.end() - m.start() < LEAST_BASE64:
            continue
        joined_run = BREAKS.sub("", m[0]).rstrip("=").replace("-", "+").replace("_", "/")
        if len(joined_run) < LEAST_BASE64:
            continue
        places = None
        for offset in range(4):
            body = joined_run[offset:]
            # A run that reaches the end of a window goes on in what follows it.
            on = layer.after is not None and m.end() == len(layer.text) and not m[0].endswith("=")
            rest = body[len(body) // 4 * 4 :] if on else ""
            body = body[: len(body) - (len(body) % 4 if on else len(body) % 4 == 1)]
            data = binascii.a2b_base64(body + "=" * (-len(body) % 4))
            text = data.decode("utf-8", "surrogateescape")
            shows, packed = HAS_TEXT.search(text), PACKED.search(data)
            if not shows and not packed:
                continue
            if places is None:
                places = _letters(m)

            def origin(a: int, b: int, offset=offset, size=len(data), places=places, m=m) -> tuple[int, int]:
                # Three bytes stand in four characters; what reaches the end has the padding too.
                last = offset + (b - 1) // 3 * 4 + (b - 1) % 3 + 1
                end = m.end() if b == size else int(places[min(last, len(places) - 1)]) + 1
                return layer.origin(int(places[offset + a // 3 * 4 + a % 3]), end)

            yield from _packed_layers(data, origin, limits, partial(unpacked_letters, rest, layer.after) if on else None)
            if not shows:
                continue
            if layer.span is not None:
                yield Layer(NO_TEXT.sub("\ufffd", text), span=layer.span)
                continue
            # Each character's bytes, and for each byte the characters that it stands in.
            sizes = np.array([1 if c < "\x80" else len(c.encode("utf-8", "surrogateescape")) for c in text])
            first = np.cumsum(sizes) - sizes
            last = first + sizes - 1
            a, b = places[offset + first // 3 * 4 + first % 3], places[np.minimum(offset + last // 3 * 4 + last % 3 + 1, len(places) - 1)]
            yield Layer(NO_TEXT.sub("\ufffd", text), a if layer.start is None else layer.start[a], b + 1 if layer.end is None else layer.end[b])


def layers_of(layer: Layer, limits: Cut) -> Iterator[Layer]:
    """What one layer unwraps to, one at a time."""
    if layer.raw:
        yield from _packed_layers(layer.raw, lambda a, b: layer.span, limits, layer.after)
    if "%" in layer.text and (new := _replaced(layer, PERCENT, _percent)):
        yield new
        whole = _replaced(layer, PERCENT, _percent_bytes)
        yield from _packed_layers(whole.text.encode("latin-1", "replace"), whole.origin, limits)
    if "\\" in layer.text and (new := _replaced(layer, ESCAPE, _escapes)):
        yield new
        yield from _packed_layers(new.text.encode("latin-1", "replace"), new.origin, limits)
    yield from _base64_layers(layer, limits)


def _letters(m: re.Match) -> np.ndarray:
    """Places of the letters of a run that may be broken."""
    parts, at = [], m.start()
    for gap in [*BREAKS.finditer(m[0]), None]:
        stop = m.start() + (gap.start() if gap else len(m[0].rstrip("=")))
        parts.append(np.arange(at, stop))
        at = m.start() + gap.end() if gap else stop
    return np.concatenate(parts)


def scan_layers(text: str, most_bytes: int | None = None) -> tuple[list, list, int, int]:
    """Base spans, all spans, layers unwrapped, and how often a bound cut one.

    With ``most_bytes``, compressed data is read up to so many bytes of content;
    without, to its end. Layers wait on a stack of iterators, of which each
    holds one window, however many there are.
    """
    base = scan(text)
    found, limits, n_layers = set(base), Cut(most_bytes), 0
    seen: set[tuple[bytes, int, int]] = set()
    work = [layers_of(Layer(text), limits)]
    while work:
        if (new := next(work[-1], None)) is None:
            work.pop()
            continue
        if not new.text:
            continue
        content = new.raw or new.text.encode("utf-8", "surrogatepass")
        mark = (hashlib.blake2b(content, digest_size=16).digest(), *new.origin(0, len(new.text)))
        if mark in seen:
            continue
        seen.add(mark)
        n_layers += 1
        for a, kind, b in scan(new.text):
            x, y = new.origin(a, b)
            found.add((x, kind, y))
        work.append(layers_of(new, limits))
    return base, sorted(found), n_layers, limits.count


def scan_secrets(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", most_bytes: int | None = None) -> DataFrame:
    """One row for each input row: counts of base secrets by kind, base and all spans as text, layers met, cuts.

    n_cut counts what ``most_bytes`` ended; without that bound nothing is cut.
    Damaged compressed data are read as far as they can be. A text whose layers
    unwrap to ever new ones without end is not told from a long one.

    Spans are kind:start:end in code points of the original text, end
    exclusive, by start, then kind as in ``KINDS``, then end, joined by commas.
    Spans of unwrapped layers cover the original characters that encode the
    secret; a span found twice counts once. A null or empty text has no
    secrets; repeated rows and null ids give a row each; other columns are
    ignored. Narrow: no shuffle.
    """
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in each_text(batches):
            columns: list[list] = [[] for _ in range(8)]
            for text in texts:
                base, every, n_layers, n_cut = scan_layers(text, most_bytes)
                counts = [sum(k == kind for _, k, _ in base) for kind in range(3)]
                for column, value in zip(columns, (*counts, joined(base), joined(every), len(every) - len(base), n_layers, n_cut), strict=True):
                    column.append(value)
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()] * 3
            names = ["doc_id", "n_assign", "n_access", "n_hex", "base", "spans", "n_added", "n_layers", "n_cut"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), text_of(text_column).alias("text")).mapInArrow(handed_back(run), SPANS)
