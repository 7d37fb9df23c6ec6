"""Secret scans: fixed patterns, and literals that a lexer finds assigned to sensitive names.

The lexer reads assignments (also with types, in chains, of subscripts, over lines in parentheses or after a plus or backslash), entries of
mappings, indented blocks, and markup elements and entries.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
# The least length of the second group of an assignment, of an access key, and of a hex run.
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
KINDS = ("assign", "access", "hex", "named")

#: Runs of hex digits that are long enough; a run's first 24 digits are found without a match for each short run.
_LONG_HEX = re.compile(r"[0-9a-f]{%d,}" % HEX_LEAST)
_LONG_ACCESS = re.compile(r"AKIA[A-Z0-9]{%d,}" % (ACCESS_LEAST - 4))
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Parts of a target name and how much they say that the value is secret.
SENSITIVE = {
    "password": 3, "passwd": 3, "passphrase": 3, "pwd": 2, "secret": 3, "token": 2, "apikey": 3, "credential": 2, "credentials": 2,
    "auth": 1, "bearer": 2, "private": 2, "access": 1, "key": 1, "api": 1, "client": 1, "signing": 1, "encryption": 1, "session": 1,
}
#: A literal is a secret when the score of its name and of its own form comes to this.
ENOUGH = 4

#: Before a value: a sign that isn't part of a comparison, arrow or path.
_SIGN = re.compile(r":=|=>|(?<![=!<>:+*/%&|^-])=(?![=>~])|(?<!:):(?![:=])")
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*(?:[.-][A-Za-z_][A-Za-z0-9_]*)*", re.ASCII)
#: Where an unquoted value ends.
_STOP = re.compile(r"[\s\"'`,;(){}\[\]<>]")
_GAP, _WIDE_GAP = re.compile(r"(?:[\x20\t]|\\\n)*"), re.compile(r"(?:\s|\\\n)*")
_STRINGS = {
    "'": re.compile(r"'((?:\\.|[^'\\\n])*)'", re.DOTALL),
    '"': re.compile(r'"((?:\\.|[^"\\\n])*)"', re.DOTALL),
    "`": re.compile(r"`((?:\\.|[^`\\])*)`", re.DOTALL),
    3 * "'": re.compile(r"'{3}((?:\\.|[^'\\]|'(?!''))*)'{3}", re.DOTALL),
    3 * '"': re.compile(r'"{3}((?:\\.|[^"\\]|"(?!""))*)"{3}', re.DOTALL),
}
_PREFIX = re.compile(r"[bfruBFRU]{1,2}(?=[\"'])")
_AGAIN = re.compile(r"(?:\[[^\]\n]*\])?[\x20\t]+=(?=[\x20\t])|(?:\[[^\]\n]*\])?=(?=[\"'])")
#: A string or word that only stands for a constant.
_REFERENCE = re.compile(r"\$(?:\{([A-Za-z_]\w*)\}|\(([A-Za-z_]\w*)\)|([A-Za-z_]\w*))", re.ASCII)
_BLOCK = re.compile(r"[\x20\t]*[|>][+-]?[0-9]?[+-]?[\x20\t]*\n")
_BELOW = re.compile(r"[\x20\t]*\n([\x20\t]+)([\"']?)([^\s:\"'#][^\s\"']*)\2[\x20\t]*(?=\n|\Z)")
_ELEMENT = re.compile(r"<([A-Za-z_][\w.:-]*)(?:\s[^<>]*)?>([^<>]*)</\1\s*>")
_TAG = re.compile(r"<[^<>]*")
_KEY, _VALUE = (re.compile(rf"\b(?:{names})\s*=\s*([\"'])([^\"'<>]*)\1") for names in ("key|name|id", "value"))
_INDENT = re.compile(r"[ \t-]*")
_PIECES = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, by start, then kind as listed; code points, end exclusive."""
    out = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _LONG_ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex") for m in _LONG_HEX.finditer(text)]
    out.sort(key=lambda x: (x[0], KINDS.index(x[2])))
    return out


def name_score(name: str) -> int:
    parts = [p.lower() for p in _PIECES.findall(name)]
    joined = [a + b for a, b in zip(parts, parts[1:])]
    return sum(SENSITIVE.get(p, 0) for p in dict.fromkeys(parts + joined))


def value_score(counts: Counter) -> int:
    """How far a literal's form is that of a secret, by its characters: long enough, of mixed ones, not a plain word."""
    n = counts.total()
    if n < 8 or len(counts) < 5 or any(c.isspace() for c in counts):
        return 0
    said = "".join(counts)
    kinds = sum(bool(re.search(x, said)) for x in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    bits = -sum(c / n * math.log2(c / n) for c in counts.values())
    return (kinds >= 2) + (kinds >= 3) + (bits >= 3.0) + (n >= 16 and bits >= 3.5)


class Lines:
    """Where the lines of a text start, and how far they are indented; a long line is gone through once, not from each of its places."""

    def __init__(self, text: str) -> None:
        self.text, self.starts, self.indents = text, [0, *(m.end() for m in re.finditer("\n", text))], {}

    def start(self, i: int) -> int:
        return self.starts[bisect_right(self.starts, i) - 1]

    def indent(self, i: int) -> int:
        """Blanks and list marks at the start of the line, up to place i."""
        line = self.start(i)
        if line not in self.indents:
            self.indents[line] = _INDENT.match(self.text, line).end()
        return min(self.indents[line], i) - line


def target(text: str, end: int, lines: Lines) -> str | None:
    """The name that stands before a sign at end: a (dotted) name, a quoted key, or the key of the last subscript."""
    i = end
    while i and text[i - 1] in " \t":
        i -= 1
    if i and text[i - 1] == "]":
        i -= 1
    if i and text[i - 1] in "\"'":
        start = text.rfind(text[i - 1], lines.start(i - 1), i - 1)
        return text[start + 1 : i - 1] if start >= 0 else None
    stop = i
    while i and (text[i - 1].isascii() and text[i - 1].isalnum() or text[i - 1] in "_.-"):
        i -= 1
    m = _NAME.search(text, i, stop)
    return m.group() if m and m.end() == stop else None


class Values:
    """Reads the value after each sign of a text, the last sign first, so that each stretch of text is gone through once.

    A value is a list of parts: ("text", start, end) of a literal, ("name", name, start, end), ("sign", place) for the value
    after a later sign (`a = b = "x"`, `a: str = "x"`), or ("?",) for what can't be known, such as a call.
    """

    def __init__(self, text: str, lines: Lines) -> None:
        self.lines = lines
        self.text, self.ahead, self.stop, self.counts = text, len(text), len(text), Counter()
        self.scores: dict[tuple[int, int], int] = {}  # of unquoted values

    def word_end(self, i: int) -> int:
        """Where the unquoted value from i on ends; its score is noted. Values that end alike are summed up from the last to the first."""
        text = self.text
        if i < self.ahead and (m := _STOP.search(text, i, self.ahead)):
            self.stop, self.counts = m.start(), Counter(text[i : m.start()])
        elif i < self.ahead and self.stop >= self.ahead:
            self.counts.update(text[i : self.ahead])
        else:
            m = _STOP.search(text, i)
            self.stop = m.start() if m else len(text)
            self.counts = Counter(text[i : self.stop])
        self.ahead, end, counts = i, self.stop, self.counts
        if end > i and text[end - 1] == "." and not text[end : end + 1].strip():  # the end of a sentence
            end, counts = end - 1, counts - Counter(".")
        self.scores[i, end] = value_score(counts)
        return end

    def after(self, sign: re.Match) -> list[tuple]:
        text, i = self.text, sign.end()
        if sign.group() == ":":
            indent = self.lines.indent(i)
            if m := _BLOCK.match(text, i):
                return self.block(m.end(), indent)
            if (m := _BELOW.match(text, i)) and len(m[1]) > indent:
                return [("text", m.start(3), m.end(3))]
        parts, deep = [], 0
        gap = _GAP
        while True:
            i = gap.match(text, i).end()
            c = text[i : i + 1]
            if c == "(":
                i, deep, gap = i + 1, deep + 1, _WIDE_GAP
                continue
            i = m.end() if (m := _PREFIX.match(text, i)) else i
            c = text[i : i + 1]
            if c and c in "\"'`":
                m = next((m for q in (3 * c, c) if q in _STRINGS and (m := _STRINGS[q].match(text, i))), None)
                if m is None:
                    return parts
                parts.append(self.named(m.start(1), m.end(1)))
                i = m.end()
                quoted = True
            else:
                end, quoted = self.word_end(i), False
                if end == i or text[i] in "+=:|>":
                    return parts if deep or parts else [("?",)]
                m = _NAME.match(text, i)
                if m and (x := _AGAIN.match(text, m.end())):
                    return [*parts, ("sign", x.end() - 1)]
                if text[end : end + 1] in ("(", "["):
                    return [*parts, ("?",)]
                if m and text[m.end() : m.end() + 1] == "+" and text.find("=", i, end) < 0 and all(_NAME.fullmatch(w) for w in text[i:end].split("+")):
                    for w in text[i:end].split("+"):
                        parts.append(("name", w, i, i + len(w)))
                        i += len(w) + 1
                else:
                    parts.append(self.named(i, end, bare=True))
                i = end
            while True:
                i = (_WIDE_GAP if deep else _GAP).match(text, i).end()
                if text[i : i + 1] != ")" or not deep:
                    break
                i, deep = i + 1, deep - 1
            c = text[i : i + 1]
            if c == "+" and text[i + 1 : i + 2] != "=":
                i, gap = i + 1, _WIDE_GAP
            elif not (quoted and c and c in "\"'" or quoted and _PREFIX.match(text, i)):
                return parts

    def named(self, start: int, end: int, bare: bool = False) -> tuple:
        if m := _REFERENCE.fullmatch(self.text, start, end):
            return ("name", m[1] or m[2] or m[3], start, end)
        return ("name", self.text[start:end], start, end) if bare and _NAME.fullmatch(self.text, start, end) else ("text", start, end)

    def block(self, i: int, indent: int) -> list[tuple]:
        """The lines of an indented block, without the marks that open and close keys."""
        text, parts = self.text, []
        while i < len(text):
            end = text.find("\n", i)
            end = len(text) if end < 0 else end
            line = text[i:end]
            bare = line.strip()
            if bare:
                start = i + len(line) - len(line.lstrip())
                if start - i <= indent:
                    break
                if not bare.startswith("-----"):
                    parts.append(("text", start, start + len(bare)))
            i = end + 1
        return parts


def pairs_of(text: str) -> tuple[list[tuple[int, str, list[tuple]]], dict[tuple[int, int], int]]:
    """(place, name, value) of each assignment, entry and element, in order; and the scores of unquoted values."""
    lines = Lines(text)
    read, out = Values(text, lines), []
    for sign in reversed(list(_SIGN.finditer(text))):
        name = target(text, sign.start(), lines)
        if name is not None and text[sign.end() : sign.end() + 2] != "//":
            out.append((sign.start(), name, read.after(sign)))
    if "</" in text:
        for m in _ELEMENT.finditer(text):
            start = m.end(2) - len(m[2].lstrip())
            out.append((m.start(), m[1], [("text", start, start + len(m[2].strip()))]))
    if "value" in text and "<" in text:
        for m in _TAG.finditer(text):
            if (key := _KEY.search(text, m.start(), m.end())) and (value := _VALUE.search(text, key.end(), m.end())):
                out.append((m.start(), key[2], [("text", value.start(2), value.end(2))]))
    out.sort(key=lambda x: x[0])
    return out, read.scores


def named_spans(text: str) -> list[tuple[int, int, str]]:
    """Literals whose target names and own form score high, also where constants carry the literal to the name.

    A name stands for what it was last given, in the order of the text; what can't be known, as of a call, ends that.
    A value's literals are the different spans that it is made of, however many names or steps there are.
    """
    low = text.lower()
    if not any(w in low for w in SENSITIVE) or not _SIGN.search(text) and "</" not in text:
        return []
    pairs, scores = pairs_of(text)
    at = {place: k for k, (place, _, _) in enumerate(pairs)}
    # what each value refers to: literals, and other values by number (those given before, or after a later sign)
    given: dict[str, int] = {}
    made: list[list | None] = [None] * len(pairs)
    whole = [False] * len(pairs)

    def referred(k: int) -> list:
        """A value by its number, or itself if it is short, so that chains of names don't get longer."""
        return made[k] if len(made[k]) < 8 else [k]

    for k, (_, name, _) in enumerate(pairs):
        chain, last = [], k
        while last is not None and made[last] is None:  # a value is made of what names are before it is given to any
            chain.append(last)
            made[last] = []
            parts = pairs[last][2]
            last = at.get(parts[-1][1]) if parts and parts[-1][0] == "sign" else None
        for x in reversed(chain):
            parts, refs = pairs[x][2], made[x]
            whole[x] = bool(parts)
            for p in parts:
                if p[0] == "text":
                    refs.append((p[1], p[2]))
                elif p[0] == "sign" and p[1] in at:
                    refs += referred(at[p[1]])
                    whole[x] &= whole[at[p[1]]]
                elif p[0] == "name" and p[1] in given:
                    refs += referred(given[p[1]])
                elif p[0] == "name" and re.search("[0-9]", p[1]):
                    refs.append((p[2], p[3]))  # an unquoted value
                else:
                    whole[x] = False
        if whole[k]:
            given[name] = k
        else:
            given.pop(name, None)
    found: set[tuple[int, int]] = set()
    forms: dict[int, tuple[int, list]] = {}  # of the values that others refer to: score and literals

    def form(refs: list) -> tuple[int, list]:
        if len(refs) == 1 and refs[0] in scores:
            return scores[refs[0]], refs
        if len(refs) == 1 and refs[0] in forms:
            return forms[refs[0]]
        literals, seen, todo = {}, set(), list(reversed(refs))
        while todo:
            x = todo.pop()
            if isinstance(x, tuple):
                literals[x] = None
            elif x not in seen:
                seen.add(x)
                todo += reversed(made[x])
        out = value_score(Counter("".join([text[a:b] for a, b in literals]))), list(literals)
        if len(refs) == 1:
            forms[refs[0]] = out
        return out

    for (_, name, _), refs in zip(pairs, made):
        score = name_score(name)
        if score and refs:
            value, literals = form(refs)
            if value >= 2 and score + value >= ENOUGH:
                found.update(x for x in literals if x[1] > x[0])
    return [(a, b, "named") for a, b in sorted(found)]


def scan(docs: DataFrame, keep: list[str], redact: str | None = None) -> DataFrame:
    """Per row: the columns of keep, then kinds array<string>, starts and ends array<int>; with redact also clean text.

    Spans come by start, then kind as listed in KINDS; code points, end exclusive. With redact, every span of the text is
    replaced by that string, spans that overlap or touch as one. Null texts count as empty (and stay null if redacted). The work is
    local to a row and takes whole texts; row order and repeated rows stay as they are. A new column whose name is in keep gets an
    underscore at its end. An empty table gives no rows.
    """
    new = [n + "_" * (n in keep) for n in ("kinds", "starts", "ends", "clean")]
    read = docs.select(*keep, *([] if "text" in keep else ["text"]))
    cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    schema = f"{cols}, {new[0]} array<string>, {new[1]} array<int>, {new[2]} array<int>" + (f", {new[3]} string" if redact is not None else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            all_spans, clean = [], []
            for text in b.column("text").to_pylist():
                t = text or ""
                spans = sorted(base_spans(t) + named_spans(t), key=lambda x: (x[0], KINDS.index(x[2]), x[1]))
                all_spans.append(spans)
                if redact is not None:
                    clean.append(text if not spans else mask(t, spans, redact))
            arrays = [b.column(c) for c in keep]
            arrays += [pa.array([[x[2] for x in s] for s in all_spans], pa.list_(pa.string())), pa.array([[x[0] for x in s] for s in all_spans], pa.list_(pa.int32())), pa.array([[x[1] for x in s] for s in all_spans], pa.list_(pa.int32()))]
            names = [*keep, *new[:3]]
            if redact is not None:
                arrays.append(pa.array(clean, pa.string()))
                names.append(new[3])
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return read.mapInArrow(run, schema)


def mask(text: str, spans: list[tuple[int, int, str]], by: str) -> str:
    out, at, end = [], 0, -1
    for a, b, _ in sorted(spans):
        if a > end:
            out += [text[at:a] if end < 0 else text[end:a], by]
        end = max(end, b)
    return "".join(out) + text[max(end, 0) :]
