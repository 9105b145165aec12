"""Personal data: rules, and a character BiLSTM-CRF that adds what they miss.

The rules find their spans in every whole text.  The model reads every place that
can hold one of the kinds: all of them contain a digit, ``@`` or a written-out "at"
(``(at)``, ``[at]``, ``name at host dot org``), so windows are laid over each of
these and its surroundings, in every whole text; nowhere else can a span be.
Windows overlap; each is decoded on its own and a character takes the tag of the
window in whose middle it lies, so a span that one window cuts is whole in the next.

A span of the model is added if its least likely character reaches the cutoff of its
kind, what the kind means holds (a dot, four numbers up to 255, a Luhn sum, 7 to 15 digits)
and it overlaps no span of the rules, which always stay.  The cutoffs are the lowest
ones with a precision of PRECISION on rows from another generator than the training
rows; a kind without one adds nothing.

The model is trained on the driver from labelled spans: ``labelled_rows`` writes
TRAIN_ROWS of them from a seed, and ``sampled_rows`` takes windows of at most
SAMPLE_DOCS documents, labelled by the rules, so that it sees the table's own prose,
numbers and hexadecimal runs.  Its weights (about 40 kB) travel with the function.

Defined results: a null or empty text has none; repeated rows and rows that share an
id are scanned alike, each on its own; of spans that start together the kind listed
first comes first; an empty table gives no rows; further columns are not read, so
their names cannot clash.  Positions are code points, end exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .pretokens import slices
from .tagger import Tagger, codes

KINDS = ("email", "ip", "card", "phone")
WIDTH, STEP, REACH = 64, 32, 24
TRAIN_ROWS, TRAIN_STEPS = 2400, 500
#: Documents whose windows are training rows, those with the least hashes of their texts, and the characters of each that are used.
SAMPLE_DOCS, SAMPLE_CHARS = 200, 20_000
PRECISION, CALIBRATION_ROWS = 0.95, 1200

_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
_EMAIL = rf"{_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++"
EMAIL_HERE, EMAIL_NEXT = re.compile(_EMAIL), re.compile(rf"(?<!{_LOCAL}){_EMAIL}")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TRIGGER = re.compile(r"[0-9@]|[(\[{<]\s?[Aa][Tt]\s?[)\]}>]|\s[Aa][Tt]\s+\S+\s+[Dd][Oo][Tt]\s")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    # a match begins where the last one ended or at the start of a run, so no run is tried twice
    while m := EMAIL_HERE.match(text, at) or EMAIL_NEXT.search(text, at):
        yield m.span()
        at = m.end()


def _number(part: str) -> bool:
    return len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255


def _is_card(text: str) -> bool:
    digits = re.sub("[^0-9]", "", text)
    return 12 <= len(digits) <= 19 and luhn(digits)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` of the rules, by start and kind."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(map(_number, m.groups()))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if m.end() - m.start() >= 12 and _is_card(m[0])]
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def _forms(rng: np.random.Generator, style: int) -> dict:
    """Writers of each kind; the two styles have other words, names, separators and layouts."""
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    digits = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    letters = lambda a, b: "".join(pick("abcdefghijklmnopqrstuvwxyz") for _ in range(int(rng.integers(a, b))))
    first = [("mary", "john", "ana", "lee", "omar"), ("peter", "ines", "kim", "sofia", "max")][style]
    host = [("example", "mail", "acme", "uni-bonn"), ("post", "web", "corp", "inbox")][style]

    def email() -> str:
        at = pick([[" (at) ", "[at]", " @ ", " [at] ", "(at)", " at ", "@"], [" [at] ", "(at)", " (AT) ", " at ", " @ ", "{at}"]][style])
        dot = "." if at == "@" else pick([" dot ", " dot ", " DOT "]) if at == " at " else pick([[" (dot) ", "[dot]", " . ", ".", " dot "], [".", " [dot] ", "(dot)", " . "]][style])
        name = pick([letters(3, 9), pick(first), pick(first) + pick([".", "_", ""]) + letters(3, 7), letters(2, 6) + digits(int(rng.integers(1, 4)))])
        return name + at + pick([letters(3, 8), pick(host)]) + dot + pick(["com", "org", "net", "de", "example" + dot + "com"])

    def ip() -> str:
        return pick([[".", "[.]", " . ", "(.)", "[.]"], ["[.]", " . ", ". ", "{.}"]][style]).join(str(x) for x in rng.integers(0, 256, 4))

    def card() -> str:
        body = pick("3456") + digits(14)
        body += next(c for c in "0123456789" if luhn(body + c))
        return pick([["", " ", "-", ".", "/", "  "], [".", " - ", "_", "/", "  "]][style]).join(body[i : i + 4] for i in range(0, 16, 4))

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        forms = [f"+1 ({a}) {b}-{c}", f"+{digits(2)} {a} {b} {c}", f"({a}) {b}-{c}", f"00{digits(2)} {a} {b} {c}", f"{a}-{b}-{c}", f"{a} {b} {c}", f"+1/{a}/{b}/{c}"]
        return pick([forms, [f"({a}) {b} {c}", f"{a}.{b}.{c}", f"+{digits(2)}/{a}/{b}{c}", f"0{digits(3)} {digits(6)}", f"00{digits(2)}-{a}-{b}-{c}", f"{a}-{b}-{c}"]][style])

    def other() -> str:
        h = "".join(pick("0123456789abcdef") for _ in range(int(rng.integers(6, 41))))
        forms = [digits(int(rng.integers(1, 8))), f"{digits(4)}-{digits(2)}-{digits(2)}", f"{digits(2)}:{digits(2)}", f"{digits(1)}.{digits(2)}", f"{digits(3)},{digits(3)}", h, f"password={h}", f'token = "{h}"', f"v{digits(1)}.{digits(1)}.{digits(2)}", "@" + letters(3, 9), f"({digits(1)})", f"AKIA{h.upper()}", f"{digits(1)}.{digits(1)}.", f"{digits(2)}.{digits(2)}.{digits(4)}", f"{digits(2)}/{digits(2)}/{digits(4)}", f"look at {letters(3, 8)} dot {letters(2, 5)}matrix"]
        return pick([forms, [*forms[:8], f"no. {digits(5)}", f"{digits(4)}/{digits(2)}", f"{digits(3)} x {digits(3)}", f"isbn {digits(3)}-{digits(1)}-{digits(4)}", f"EUR {digits(3)}.{digits(3)},{digits(2)}", f"§ {digits(2)}"]][style])

    return {"email": email, "ip": ip, "card": card, "phone": phone, "other": other}


def labelled_rows(n: int = TRAIN_ROWS, seed: int = 3, style: int = 0) -> tuple[list[str], list[list[tuple[str, int, int]]]]:
    """Texts of WIDTH characters with their spans: plain and written-out personal data in invented prose."""
    rng = np.random.default_rng(seed)
    parts = "an en er in on re st th ti or ea es ed he is le au ou ch ver und ein que la os ción é ü ñ ê ß".split()
    plain = "please write to our office or call the new number of this team before noon and ask for more about it at once dot matrix".split()
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    word = lambda: pick(plain) if rng.random() < (0.3, 0.9)[style] else "".join(pick(parts) for _ in range(int(rng.integers(1, 5))))
    cue = ["mail ", "e-mail: ", "call ", "tel. ", "phone ", "ip ", "host ", "card ", "no. ", ""]
    forms = _forms(rng, style)
    texts, spans = [], []
    for _ in range(n):
        text, found = "", []
        for _ in range(int(rng.integers(0, 7))):
            text += word() + pick([" ", " ", ", ", ". ", "\n"])
        kind = pick([*KINDS, *KINDS, "other", "other", "other", "none"])
        if kind != "none":
            text += pick(cue) if rng.random() < 0.5 else ""
            start = len(text)
            text += forms[kind]()
            if kind in KINDS:
                found.append((kind, start, len(text)))
            text += pick([" ", ", ", ". ", "\n", ") "])
        while len(text) < WIDTH:
            text += word() + pick([" ", " ", ", "])
        texts.append(text[:WIDTH])
        spans.append([(k, a, min(b, WIDTH)) for k, a, b in found if a < WIDTH])
    return texts, spans


def sampled_rows(docs: DataFrame, limit: int = SAMPLE_DOCS) -> tuple:
    """``(text of WIDTH characters, spans of the rules)`` around what triggers the model in ``limit`` documents.

    The documents are those of the least hash in each of ``limit`` classes of hashes, which
    one partial minimum a class finds, however many partitions there are.
    A run of 12 to 19 digits counts as a card whatever its Luhn sum, which no character shows.
    """
    key = F.xxhash64("text")
    least = docs.where("text rlike '[0-9@]'").groupBy(F.pmod(key, F.lit(limit))).agg(F.min(key).alias("h"))
    # equal texts are one; at most ``limit`` rows are broadcast, and come to the driver
    found = docs.select(key.alias("h"), F.left("text", F.lit(SAMPLE_CHARS)).alias("text")).join(F.broadcast(least), "h", "left_semi")
    rows = found.groupBy("h").agg(F.first("text").alias("text")).orderBy("h").collect()
    out = []
    for text in (r["text"] for r in rows):
        known = [*base_spans(text), *(("card", *m.span()) for m in CARD.finditer(text) if 12 <= sum(c.isdigit() for c in m[0]) <= 19)]
        for s in _windows(text)[:8]:
            part = text[s : s + WIDTH].ljust(WIDTH)
            out.append((part, tuple(sorted({(k, max(a, s) - s, min(b, s + WIDTH) - s) for k, a, b in known if a < s + WIDTH and b > s}, key=lambda x: x[1]))))
    return tuple(out)


def _tags(spans: list[tuple[str, int, int]], width: int = WIDTH) -> np.ndarray:
    out = np.zeros(width, np.int64)
    for kind, a, b in spans:
        k = 1 + 2 * KINDS.index(kind)
        out[a:b] = k + 1
        out[a] = k
    return out


_trained: dict[tuple, tuple[Tagger, dict[str, float]]] = {}


def train(rows: int = TRAIN_ROWS, steps: int = TRAIN_STEPS, more: tuple = ()) -> tuple[Tagger, dict[str, float]]:
    """The model and its cutoffs; ``more``: further ``(text of WIDTH characters, spans)``.  The result depends on the arguments alone."""
    if (rows, steps, more) not in _trained:
        texts, spans = labelled_rows(rows)
        texts, spans = texts + [t for t, _ in more], spans + [list(s) for _, s in more]
        model = Tagger(1 + 2 * len(KINDS))
        model.fit(np.stack([codes(t) for t in texts]), np.stack([_tags(s) for s in spans]), steps)
        _trained.clear()
        _trained[rows, steps, more] = model, calibrated(model)
    return _trained[rows, steps, more]


def calibrated(model: Tagger, rows: int = CALIBRATION_ROWS, precision: float = PRECISION) -> dict[str, float]:
    """For each kind the lowest cutoff at and above which ``precision`` of its spans is right, on rows of the other style."""
    texts, spans = labelled_rows(rows, seed=17, style=1)
    found: dict[str, list[tuple[float, bool]]] = {k: [] for k in KINDS}
    for true, got in zip(spans, scored_spans(texts, model), strict=True):
        for kind, a, b, p in got:
            found[kind].append((p, any(k == kind and a < y and x < b for k, x, y in true)))
    out = {}
    for kind, seen in found.items():
        seen.sort(reverse=True)
        right, out[kind] = 0, 2.0
        for n, (p, ok) in enumerate(seen, 1):
            right += ok
            if right >= precision * n and n >= 20:
                out[kind] = p
    return out


def _windows(text: str) -> list[int]:
    """Starts of the windows: a grid of STEP, where a trigger is within REACH of the window."""
    starts: dict[int, None] = {}
    top = max(0, len(text) - WIDTH)
    for m in TRIGGER.finditer(text):
        first = max(0, (m.start() - REACH - WIDTH) // STEP + 1)
        for k in range(first, (m.end() + REACH) // STEP + 1):
            starts[min(k * STEP, top)] = None
    return list(starts)


def _holds(kind: str, text: str) -> bool:
    """What the kind means, whatever its layout."""
    numbers = re.findall("[0-9]+", text)
    if kind == "email":
        return text[0].isalnum() and text[-1].isalnum() and re.search(r"\.|\bdot\b", text.lower()) is not None
    if kind == "ip":
        return len(numbers) == 4 and all(map(_number, numbers))
    if kind == "card":
        return 12 <= sum(map(len, numbers)) <= 19 and luhn("".join(numbers))
    return 7 <= sum(map(len, numbers)) <= 15


def scored_spans(texts: list[str], model: Tagger) -> list[list[tuple[str, int, int, float]]]:
    """The model's spans of each text, reconciled over its windows, with the chance of their least likely character."""
    places = [(i, s) for i, t in enumerate(texts) for s in _windows(t)]
    out: list[list[tuple[str, int, int, float]]] = [[] for _ in texts]
    known: dict[int, dict[int, tuple[int, int, float]]] = {}
    for at in range(0, len(places), 512):
        part = places[at : at + 512]
        rows = np.full((len(part), WIDTH), 32, np.int64)
        for r, (i, s) in enumerate(part):
            c = codes(texts[i][s : s + WIDTH])
            rows[r, : len(c)] = c
        tags, likely = model.decode(rows)
        for r, (i, s) in enumerate(part):
            if not tags[r].any():
                continue
            n = min(WIDTH, len(texts[i]) - s)
            cells = known.setdefault(i, {})
            for k, (tag, p) in enumerate(zip(tags[r, :n].tolist(), likely[r, :n].tolist(), strict=True)):
                # distance from the nearer end of the window, whose text is known there
                rank = min(k if s else WIDTH, n - 1 - k if s + n < len(texts[i]) else WIDTH)
                if s + k not in cells or rank > cells[s + k][0]:
                    cells[s + k] = (rank, tag, p)
    for i, cells in known.items():
        start = kind = None
        low = 1.0
        for p in [*sorted(cells), -1]:
            tag, p_here = cells[p][1:] if p >= 0 else (0, 1.0)
            inside = start is not None and tag == 2 * kind + 2 and p == end
            if start is not None and not inside:
                text = texts[i][start:end]
                a, b = start + len(text) - len(text.lstrip()), start + len(text.rstrip(" \n\t.,;:"))
                if b > a and _holds(KINDS[kind], texts[i][a:b]):
                    out[i].append((KINDS[kind], a, b, low))
                start = None
            if inside:
                end, low = p + 1, min(low, p_here)
            elif tag % 2:
                start, end, kind, low = p, p + 1, tag // 2, p_here
    return out


def all_spans(texts: list[str], model: Tagger, cutoffs: dict[str, float]) -> list[tuple[list, list]]:
    """``(base, all)`` of each text."""
    out = []
    base = [base_spans(t) for t in texts]
    for found, more in zip(base, scored_spans(texts, model), strict=True):
        add = [(k, a, b) for k, a, b, p in more if p >= cutoffs[k] and all(b <= x or y <= a for _, x, y in found)]
        out.append((found, sorted(found + add, key=lambda x: (x[1], KINDS.index(x[0])))))
    return out


def find_pii(docs: DataFrame, rows: int = TRAIN_ROWS, steps: int = TRAIN_STEPS) -> DataFrame:
    """``doc_id, pii array<struct<kind, start, end, rule>>``; one pass, no shuffle."""
    model, cutoffs = train(rows, steps, sampled_rows(docs))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("rule", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = []
                for base, both in all_spans([t or "" for t in part.column(1).to_pylist()], model, cutoffs):
                    rules = set(base)
                    found.append([{"kind": x[0], "start": x[1], "end": x[2], "rule": x in rules} for x in both])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, kind)], ["doc_id", "pii"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, pii array<struct<kind:string,start:int,end:int,rule:boolean>>")


def op6_pii(spark, sf_dir) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    line = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("pii", lambda x: x["rule"])
    count = lambda k: F.size(F.filter("pii", lambda x: x["rule"] & (x["kind"] == k))).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(line(base).cast("binary"), 256).alias("base_sha256"), line(F.col("pii")).alias("spans"))


QUERIES = {"op6_pii": op6_pii}
SQL: dict[str, str] = {}
