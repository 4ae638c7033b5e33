"""What a delimited file is: compression by magic bytes, byte order mark, delimiter by a sample, names by its header."""

import bz2
import csv
import re
import zlib
from dataclasses import dataclass

#: Fixed values of the formats.
GZIP, BZIP2, BOM = b"\x1f\x8b", b"BZh", b"\xef\xbb\xbf"
SAMPLE = 64 << 10
#: Bytes of a file that are sure to hold the start of its content: a bzip2 block has up to 900 kB, and says nothing before its end.
HEAD = 2 << 20
DELIMITERS = (",", ";", " ", "|")


@dataclass(frozen=True)
class Format:
    compression: str | None
    bom: bool
    delimiter: str


def head(raw: bytes) -> tuple[str | None, bytes]:
    """Compression and the start of the content, from the start of the file."""
    if raw.startswith(GZIP):
        return "gzip", zlib.decompressobj(31).decompress(raw, SAMPLE)
    if raw.startswith(BZIP2):
        return "bzip2", bz2.BZ2Decompressor().decompress(raw, SAMPLE)
    return None, raw[:SAMPLE]


def widths(sample: str, delimiter: str) -> list[int]:
    out = []
    try:
        for row in csv.reader(sample.splitlines(keepends=True), delimiter=delimiter):
            if row:
                out.append(len(row))
            if len(out) == 2:
                break
    except csv.Error:
        return []
    return out


def sniff(raw: bytes) -> Format:
    """A tab wins if it cuts the first two rows alike; then , ; blank and | in turn; else a comma."""
    compression, sample = head(raw)
    bom = sample.startswith(BOM)
    text = (sample[len(BOM) :] if bom else sample).decode("utf-8", "replace")
    lines = [x for x in re.split(r"\r?\n", text) if x][:2]
    if lines and len({len(x.split("\t")) for x in lines}) == 1 and "\t" in lines[0]:
        return Format(compression, bom, "\t")
    for d in DELIMITERS:
        w = widths(text, d)
        if w and len(set(w)) == 1 and w[0] > 1:
            return Format(compression, bom, d)
    return Format(compression, bom, ",")


def clean(name: str, prefix: str = "column") -> str:
    """Lower case with underscores: trimmed, other bytes to _, camel case cut, and the prefix if no letter leads."""
    text = re.sub(r"[^A-Za-z0-9_]", "_", name.strip())
    text = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", text)
    text = re.sub(r"_+", "_", text).strip("_").lower()
    return text if re.match("[a-z]", text) else f"{prefix}_{text}".rstrip("_")


def clean_all(names: list[str]) -> list[str]:
    """Cleaned names; repeated ones, and those that are nothing but the prefix, get a number."""
    cleaned, out = [clean(n) for n in names], []
    for n in cleaned:
        k, name = 1, n
        if n == "column" or cleaned.count(n) > 1:
            name = f"{n}_{k:02d}"
        while name in out:
            k += 1
            name = f"{n}_{k:02d}"
        out.append(name)
    return out
