"""Personal data: base patterns on the text itself, and the same patterns on a deobfuscated text whose spans map back.

Transducers rewrite homoglyphs, digit names (also among numerals) and at/dot disguises; each keeps, for every rewritten piece, where it
came from, so a span found in the normalised text becomes a span of source characters. Characters without width vanish. Addresses whose four parts are numerals or digit names
with plain, bracketed or spelled dots are sought as such. Base spans always stay; a disguised one is added where it holds a rewritten
piece and those of its kind that it meets lie within it. Digit names are English; names of larger numbers ("ninety") are not read.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right, insort

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.common import map_batches
from tidegraph.llm.top_level import TOP

KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Letters of other scripts that look like Latin ones.
LOOKALIKE = dict(zip("аеорсухіјѕԁһԛԝАВЕКМНОРСТХІЈЅοαερυιΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdhqwABEKMHOPCTXIJSoaepuiABEZHIKMNOPTYX", strict=True))
#: Soft hyphen, zero-width space, non-joiner and joiner, word joiner, byte order mark.
WIDTHLESS = "\xad\u200b\u200c\u200d\u2060\ufeff"
#: English names of digits.
DIGITS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
SPELLED = re.compile(rf"(?i)\b(?:plus[\s-]+)?(?:{'|'.join(DIGITS)})(?:[\s,.-]+(?:{'|'.join(DIGITS)})){{6,}}\b")
WORD = re.compile(r"[A-Za-z]+")
#: Numerals and digit names in a row, in any mixture.
NUMBER = rf"(?:(?:{'|'.join(DIGITS)})\b|[0-9]++\b)"
MIXED = re.compile(rf"(?i)(?P<plus>\bplus[\s-]++)?\b{NUMBER}(?:[\s,.()-]++{NUMBER})++")
NUMBER_RE = re.compile(rf"(?i)\b{NUMBER}")
NAMED = re.compile(rf"(?i)\b(?:{'|'.join(DIGITS)})\b")
AT, DOT = r"(?:\s*[\[({<]\s*(?:at|@)\s*[\])}>]\s*|\s+at\s+)", r"(?:\s*[\[({<]\s*(?:dot|\.)\s*[\])}>]\s*|\s+dot\s+)"
SHORT = rf"(?:{'|'.join(DIGITS)}|[0-9]{{1,2}})\b"
PART, PART_DOT = rf"([0-9]++|{SHORT}(?:[\s-]+{SHORT}){{0,2}})", rf"(?:{DOT}|(?<=[0-9])dot(?=[0-9])|\.)"
SPELLED_IP = re.compile(rf"(?i)(?<![A-Za-z0-9]){PART}{PART_DOT}{PART}{PART_DOT}{PART}{PART_DOT}{PART}")
BRACKETED = re.compile(r"(?i)[\[({<]\s*(?:at|[@.])")
DISGUISE = re.compile(rf"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-]++(?:(?:\.|{DOT})[A-Za-z0-9_%+-]++)*?(?P<at>{AT}|@)[A-Za-z0-9-]++(?:(?:\.|{DOT})[A-Za-z0-9-]++)+")
AT_RE, DOT_RE, BARE_AT = re.compile(rf"(?i){AT}"), re.compile(rf"(?i){DOT}"), re.compile(r"(?i)\s+at\s+\Z")

Piece = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Spans of [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+, leftmost and non-overlapping, in linear time: each @ ends
    the only local part that it can have, which begins at its run or at the end of the match before."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        k = at
        while k > done and (text[k - 1].isalnum() and text[k - 1].isascii() or text[k - 1] in "._%+-"):
            k -= 1
        if k < at and (m := DOMAIN.match(text, at)):
            out.append((k, m.end()))
            done = m.end()
        at = text.find("@", at + 1)
    return out


def find_all(text: str) -> dict[str, list[tuple[int, int]]]:
    """The base spans of a text by kind."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = emails(text)
    if "." in text:
        out["ip"] = [m.span() for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out["card"].append(m.span())
    if "+" in text:
        out["phone"] = [m.span() for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def homoglyphs(text: str) -> list[Piece]:
    """Look-alike letters, full-width characters and digits of other scripts as (start, end, replacement); characters without width go."""
    out = []
    for m in re.finditer(r"[^\x00-\xac\xae-˿]", text):
        c = m[0]
        if c in WIDTHLESS:
            new = ""
        elif (new := LOOKALIKE.get(c)) is None:
            if "！" <= c <= "～":
                new = chr(ord(c) - 0xFEE0)
            elif (d := unicodedata.decimal(c, None)) is not None:
                new = str(d)
            elif "\U0001d400" <= c <= "\U0001d7ff" or c in "․。｡":
                new = unicodedata.normalize("NFKC", c) if c > "￿" else "."
        if new is not None and len(new) < 2 and new.isascii():
            out.append((m.start(), m.end(), new))
    return out


def spelled_digits(text: str) -> list[Piece]:
    """Seven and more digit names in a row as digits; a plus before them as +."""
    low = text.lower()
    if sum(low.count(w) for w in DIGITS) < 7:
        return []
    out = []
    for run in SPELLED.finditer(text):
        words = list(WORD.finditer(text, run.start(), run.end()))
        for m, after in zip(words, [*words[1:], None], strict=True):
            new = DIGITS.get(m[0].lower(), "+")
            out.append((m.start(), after.start() if after else m.end(), new))
    return out


def mixed_digits(text: str) -> list[Piece]:
    """Digit names among numerals as digits, joined to their neighbours, in runs of eight digits and more (no phone or card has fewer); a plus
    before them as +."""
    if not NAMED.search(text):
        return []
    out = []
    for run in MIXED.finditer(text):
        words = list(NUMBER_RE.finditer(text, run.end("plus") if run["plus"] else run.start(), run.end()))
        if all(m[0][0].isdigit() for m in words) or sum(len(m[0]) if m[0][0].isdigit() else 1 for m in words) < 8:
            continue
        if run["plus"]:
            out.append((*run.span("plus"), "+"))
        for before, m, after in zip([None, *words], words, [*words[1:], None], strict=False):
            if not m[0][0].isdigit():
                out.append((before.end() if before and before[0][0].isdigit() else m.start(), after.start() if after else m.end(), DIGITS[m[0].lower()]))
    return out


def spelled_ips(text: str) -> list[tuple[int, int]]:
    """Spans of addresses with a digit name or a disguised dot; a last part above 255 loses words from its end."""
    low = text.lower()
    if "dot" not in low and not BRACKETED.search(text) and not any(f"{w}." in low or f".{w}" in low for w in DIGITS):
        return []
    out, at = [], 0
    while m := SPELLED_IP.search(text, at):
        at = m.end()
        if IP.fullmatch(m[0]):
            continue
        parts = [list(NUMBER_RE.finditer(text, *m.span(k))) for k in (1, 2, 3, 4)]
        value = lambda part: "".join(DIGITS.get(x[0].lower(), x[0]) for x in part).lstrip("0")
        fits = lambda part: len(value(part)) <= 3 and int(value(part) or 0) <= 255
        while len(parts[3]) > 1 and not fits(parts[3]):
            parts[3].pop()
        if all(map(fits, parts)):
            at = parts[3][-1].end() if parts[3] else m.end()
            out.append((m.start(), at))
        else:
            at = m.start() + 1
    return out


def at_dot(text: str) -> list[Piece]:
    """Disguised @ and dots of addresses. A bare word "at" counts only if a dot of its domain is disguised as well,
    in brackets or before a top-level domain."""
    low = text.lower()
    if "dot" not in low and not BRACKETED.search(text):
        return []
    out = []
    for m in DISGUISE.finditer(text):
        a, b = m.span("at")
        dots = [d for d in DOT_RE.finditer(text, m.start(), m.end())]
        last = re.split(r"[^A-Za-z0-9-]+", m[0])[-1].lower()
        if BARE_AT.match(text[a:b]) and not any(d.start() >= b and (d[0].strip().lower() != "dot" or last in TOP or last.startswith("xn--")) for d in dots):
            continue
        out += [(d.start(), d.end(), ".") for d in dots if d.end() <= a or d.start() >= b]
        if text[a:b] != "@":
            out.append((a, b, "@"))
    return sorted(out)


class Normalised:
    """A text and, for each of its characters, the source span that it stands for."""

    def __init__(self, text: str):
        self.text, self.source, self.pieces = text, text, []  # pieces: normalised start, end, source start, end

    def apply(self, transducer) -> None:
        changes = transducer(self.text)
        if not changes:
            return
        parts, pieces, at, new_at = [], [], 0, 0
        for a, b, new in changes:
            parts += [self.text[at:a], new]
            new_at += a - at
            pieces.append((new_at, new_at + len(new), *self.to_source(a, b)))
            new_at += len(new)
            at = b
        parts.append(self.text[at:])
        kept, shift = [], 0
        marks = iter([*changes, (len(self.text) + 1, len(self.text) + 1, "")])
        change = next(marks)
        for p in self.pieces:  # pieces outside the changes move with the text, the others are inside new ones
            while change[1] <= p[0]:
                shift += len(change[2]) - (change[1] - change[0])
                change = next(marks)
            if p[1] <= change[0]:
                kept.append((p[0] + shift, p[1] + shift, p[2], p[3]))
        self.text, self.pieces = "".join(parts), sorted(pieces + kept)

    def to_source(self, a: int, b: int) -> tuple[int, int]:
        return self.point(a, 0), self.point(b - 1, 1)

    def point(self, k: int, end: int) -> int:
        at = bisect_right(self.pieces, (k, float("inf"))) - 1
        if at < 0:
            return k + end
        p = self.pieces[at]
        return p[2 + end] if k < p[1] else k - p[1] + p[3] + end

    def rewritten(self, a: int, b: int) -> bool:
        at = bisect_right(self.pieces, (b - 1, float("inf"))) - 1
        return at >= 0 and self.pieces[at][1] > a


def find_pii(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans, as (kind, start, end) by kind, then start."""
    text = text or ""
    base = find_all(text)
    every = {k: list(v) for k, v in base.items()}
    plain = Normalised(text)
    if not text.isascii():
        plain.apply(homoglyphs)

    cover = {k: list(v) for k, v in base.items()}  # spans of a kind that lie apart; a longer one takes the place of those within it

    def add(kind: str, a: int, b: int) -> None:
        own = cover[kind]
        k = bisect_right(own, (a, a))
        first = k - 1 if k and own[k - 1][1] > a else k
        last = bisect_right(own, (b - 1, float("inf")), first)
        met = own[first:last]
        if (a, b) not in met and all(a <= x and y <= b for x, y in met):
            own[first:last] = [(a, b)]
            insort(every[kind], (a, b))

    for transducer in (spelled_digits, mixed_digits):  # digits beside a spelled-out number need not belong to it
        n = Normalised(text)
        n.text, n.pieces = plain.text, list(plain.pieces)
        n.apply(transducer)
        if transducer is mixed_digits and n.text == plain.text:
            break
        n.apply(at_dot)
        if n.pieces:
            for kind, spans in find_all(n.text).items():
                for a, b in spans:
                    if n.rewritten(a, b):
                        add(kind, *n.to_source(a, b))
    for a, b in spelled_ips(plain.text):
        add("ip", *plain.to_source(a, b))
    return [(k, *s) for k in KINDS for s in base[k]], [(k, *s) for k in KINDS for s in every[k]]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span (overlapping ones as one) replaced by [KIND] of the first."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def detect_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all), masked (the text).

    No shuffle; whole texts, offsets in code points, end exclusive. Null text counts as empty, and its masked text is null. Repeated
    rows stay; an empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                base, every = find_pii(text)
                counts = [sum(s[0] == k for s in base) for k in KINDS]
                out.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), None if text is None else masked(text, every) if every else text))
            cols = list(zip(*out, strict=True))
            kinds = [pa.int64()] * 4 + [pa.string()] * 3
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=["id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "masked"])

    return map_batches(rows, run, "id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, masked string").withColumnRenamed("id", id_col)


def mask_texts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with all found spans masked in text_col; other columns, whatever their names, stay as they are. Null texts stay null and empty ones
    empty; repeated rows stay; an empty table gives no rows."""

    fields = docs.columns
    place = f"f{fields.index(text_col)}"
    rows = docs.select(F.struct(*[F.col(f"`{c}`").alias(f"f{k}") for k, c in enumerate(fields)]).alias("row"))

    def run(batches):
        for batch in batches:
            texts = batch.column("row").field(place).to_pylist()
            clean = [None if t is None else masked(t, found) if (found := find_pii(t)[1]) else t for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(clean, pa.string())], names=["row", "clean"])

    out = map_batches(rows, run, f"row {rows.schema['row'].dataType.simpleString()}, clean string")
    return out.select(*[F.col("clean" if c == text_col else f"row.f{k}").alias(c) for k, c in enumerate(fields)])
