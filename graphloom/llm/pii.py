"""Surrogates for personal data and secrets.

Detected entities are replaced by keyed surrogates of the same type. The variable characters
of an entity are one number in a mixed radix (digits by digits, letters by letters of the
same case, script and sound), which a keyed Feistel permutation maps to another number of the
same format. So one entity always gets one surrogate (coreference across all documents), two
entities of a format never share one, and length, grouping, country code and card issuer stay; what had a
valid check digit (cards, IBANs) or a number that is given out (SSNs) gets another such.
Given names map to other names of their script and gender.

Names are found by a title, a common given name or a phrase that introduces one ("my name
is"); parts of a found name that stand alone elsewhere in the same text are replaced alike.

A collision check over the distinct entities of all documents finds surrogates that equal
themselves, a real entity or another surrogate; those entities are keyed again until none is
left. A name, mail address or secret whose format has too few values left grows by letters; for
other types a corpus that uses up a format is an error. The few rekeyed entities reach the tasks
as a table of at most ``BROADCAST_ROWS`` rows; more are joined in by document instead.

The key comes from the session's ``spark.graphloom.surrogateKey`` (hexadecimal); without one it
is drawn at random and kept for the session, so that no one can undo the permutations.

Edge cases: a null text stays null and an empty one empty; a very long text is searched whole;
overlapping finds keep the leftmost, then the first type listed; repeated rows get equal
results; an empty table gives no rows; other columns are kept, whatever their names. Texts
without finds come back unchanged.
"""

from __future__ import annotations

import hashlib
import hmac
import math
import re
import secrets
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.memory import claim, register
from graphloom.llm.names import BY_KIND, GIVEN
from graphloom.operators.skew import join_unique
from graphloom.session import free_names, materialize, text_batches

BROADCAST_ROWS = 100_000
#: Rounds of rekeying, and after how many a growing format gains a syllable each time.
MAX_ATTEMPTS, GROW = 50, 10
_ROUNDS = 8

_HONORIFIC = "Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Mme|Mlle|Monsieur|Madame|Señor|Señora|Sr|Sra|Doña|г-н|г-жа"
_CAPS_HONORIFIC = "MR|MRS|MS|DR|PROF|HERR|FRAU"
_GIVEN = "|".join(sorted(GIVEN, key=len, reverse=True))
_LETTERS = [chr(i) for i in (*range(0x41, 0x250), *range(0x386, 0x530)) if chr(i).isalpha()]
_UP, _LOW = ("".join(c for c in _LETTERS if f(c)) for f in (str.isupper, str.islower))
_PART = f"(?:[{_UP}]['’])?[{_UP}][{_LOW}]+(?:[{_UP}][{_LOW}]+)?"
_SURNAME = f"{_PART}(?:-{_PART})?"
_PARTICLE = "von|van|zu|zum|der|den|de|del|della|da|do|dos|di|du|la|le|el|al|bin|ibn"
_GAP = "[ \\n]"
#: Between a given name and a surname: initials and particles.
_BETWEEN = f"(?:[{_UP}]\\.{_GAP})?(?:(?:{_PARTICLE}){_GAP}){{0,2}}"
_INTRO = "name is|named|[Ss]igned by|[Nn]ame:|[Cc]ontact:|[Aa]uthor:|Dear|[Rr]egards,|[Ss]incerely,"

_KINDS: list[tuple[str, str]] = [
    ("email", r"(?<![\w.%+-])[^\W_][\w.%+-]*@(?:[^\W_](?:[\w-]*[^\W_])?\.)+[^\W\d_]{2,}"),
    ("aws_key", r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])"),
    ("token", r"(?<![A-Za-z0-9_])(?:gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,})"),
    ("secret", r"(?i:\b(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth[_-]?token))[\"']?\s{0,3}[:=]\s{0,3}[\"']?(?P<secret_value>[A-Za-z0-9+/_.-]{6,}=*)"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    ("card", r"(?<![\d.-])(?:\d{13,19}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7})(?![\d-])"),
    ("phone", r"(?<![\w+.])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}[.-]\d{3}[.-]\d{4}|(?<![\d/,-])(?:0[1-9]\d{0,3}[ /-]\d{2,8}|\(0[1-9]\d{0,3}\) ?\d{2,8})(?:[ -]\d{2,8}){0,4})(?![\w-])"),
    ("ip", r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)"),
    ("ip6", r"(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:]|\.\d)"),
    (
        "name",
        rf"(?<!\w)(?:(?:{_HONORIFIC})\.?{_GAP}(?:(?:{_GIVEN}){_GAP})?{_BETWEEN}{_SURNAME}|(?:{_CAPS_HONORIFIC})\.?{_GAP}[{_UP}]{{2,}}|(?:{_GIVEN}){_GAP}{_BETWEEN}{_SURNAME}"
        rf"|(?:{_INTRO})\s(?P<intro_name>{_PART}{_GAP}{_BETWEEN}{_SURNAME}))(?!\w)",
    ),
]
_ANY = re.compile("|".join(f"(?P<{k}>{p})" for k, p in _KINDS))
#: A cheap necessary condition, for RE2: most texts hold nothing and skip the search above.
_MAYBE = (
    rf"@[\p{{L}}0-9]|\+[0-9]|[0-9]{{3}}|[0-9]\.[0-9]|0[1-9][0-9]{{0,3}}\)?[ /-]?[0-9]|[0-9A-Fa-f]:[0-9A-Fa-f:]|[A-Z]{{2}}[0-9]{{2}} ?[A-Z0-9]{{4}}|AKIA|ASIA|gh[pousr]_|sk-|xox|eyJ"
    rf"|(?i:passw|pwd|secret|token|api[_-]?key|access[_-]?key)|(?:{_HONORIFIC}|{_CAPS_HONORIFIC}|{_GIVEN})\.?[ \n](?:\p{{Lu}}|(?:{_PARTICLE})[ \n])|(?:{_INTRO})\s\p{{Lu}}"
)
_HEAD = re.compile(rf"(?:(?P<title>{_HONORIFIC}|{_CAPS_HONORIFIC})\.?{_GAP})?(?:(?P<given>{_GIVEN})(?:{_GAP}|$))?(?:[{_UP}]\.{_GAP})?(?:(?:{_PARTICLE}){_GAP}){{0,2}}(?P<last>.*)", re.S)
#: What separates the parts of a name after its given name; initials and particles are no parts.
_SEPARATOR = re.compile(rf"((?:{_GAP}|-|^)(?:[{_UP}]\.{_GAP})?(?:(?:{_PARTICLE}){_GAP}){{0,2}})")


def luhn_digit(digits: list[int]) -> int:
    """The check digit that follows ``digits``."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = d * 2 if i % 2 == 0 else d
        total += d - 9 if d > 9 else d
    return -total % 10


_ALPHABETS = ["0123456789"] + [
    a
    for low in ("aeiou", "bcdfghjklmnpqrstvwxyz", "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "αεηιουω", "βγδζθκλμνξπρσςτφχψ", "äöü", "áéíóú", "àèìòù", "âêîôû", "çñ", "ãõ")
    for a in (low, low.upper() if len(low.upper()) == len(low) and len(set(low.upper())) == len(low) else "")
    if a
]
_CLASS = {c: a for a in reversed(_ALPHABETS) for c in a}
_HEX = "0123456789abcdef"
_BASE36 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"


def _prf(key: bytes, *parts: object) -> int:
    return int.from_bytes(hmac.new(key, "\x1f".join(map(str, parts)).encode(), hashlib.sha256).digest(), "big")


def permute(key: bytes, tweak: str, value: int, size: int) -> int:
    """A keyed permutation of range(size): Feistel rounds with cycle walking."""
    if size <= 1:
        return value
    a = math.isqrt(size - 1) + 1
    b = -(-size // a)
    wide = -(-max(a, b).bit_length() // 200)
    while True:
        left, right = divmod(value, b)
        for r in range(_ROUNDS):
            if r % 2:
                right = (right + sum(_prf(key, tweak, r, left, i) << 256 * i for i in range(wide))) % b
            else:
                left = (left + sum(_prf(key, tweak, r, right, i) << 256 * i for i in range(wide))) % a
        value = left * b + right
        if value < size:
            return value


def _swap(key: bytes, tweak: str, text: str, alphabets: list[str]) -> str:
    """Permute the characters of ``text`` that have an alphabet ('' keeps one)."""
    value, size = 0, 1
    for c, a in zip(text, alphabets):
        if a:
            value = value * len(a) + a.index(c)
            size *= len(a)
    value = permute(key, tweak + "|" + ",".join(map(str, (len(a) or c for c, a in zip(text, alphabets)))), value, size)
    out = []
    for c, a in zip(reversed(text), reversed(alphabets)):
        if a:
            value, i = divmod(value, len(a))
            c = a[i]
        out.append(c)
    return "".join(reversed(out))


def _by_class(text: str) -> list[str]:
    return [_CLASS.get(c, "") for c in text]


def _mixed_secret(text: str) -> list[str]:
    if all(c in _HEX for c in text):
        return [_HEX] * len(text)
    return ["0123456789" if c.isdigit() and c.isascii() else ("abcdefghijklmnopqrstuvwxyz" if c.islower() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ") if c.isascii() and c.isalpha() else "" for c in text]


def normal(kind: str, text: str) -> list[tuple[str, str]]:
    """What identifies an entity, whatever its layout: (type, value) parts that are replaced."""
    if kind == "name":
        m = _HEAD.fullmatch(text)
        parts = [("given", m["given"])] if m["given"] else []
        return parts + [("surname", p) for p in _SEPARATOR.split(m["last"])[::2] if p]
    if kind in ("phone", "card", "iban", "ssn"):
        return [(kind, "".join(c for c in text if c.isalnum()))] if kind != "phone" else [(kind, _country(text) + "|" + "".join(c for c in _local(text) if c.isdigit()))]
    return [(kind, text.lower() if kind in ("email", "ip6") else text)]


def _country(phone: str) -> str:
    if phone[0] in "0(":  # the zero before an area code stays
        return phone[: phone.index("0") + 1] if re.match(r"\(?0", phone) else ""
    m = re.match(r"\+\d{1,3}(?=[ .(-])", phone)
    return m[0] if m else phone[:2] if phone[0] == "+" else ""


def _local(phone: str) -> str:
    return phone[len(_country(phone)) :]


@lru_cache(maxsize=100)
def _ring(key: bytes, kind: tuple[str, str]) -> list[str]:
    """The names of a script and gender in keyed order."""
    return sorted(BY_KIND[kind], key=lambda n: _prf(key, "ring", *kind, n))


def _grown(key: bytes, kind: str, value: str, attempt: int) -> str:
    """Letters that a surrogate gains where its format has few values: a syllable for every ``GROW`` attempts."""
    low, out = value[-1:].islower() or not value[-1:].isalpha(), ""
    for i in range(attempt // GROW):
        n = _prf(key, "grown", kind, value, attempt, i)
        out += "bdfgklmnprst"[n % 12] + "aeiou"[n // 12 % 5]
    return out if low else out.upper()


def iban_check(country: str, rest: str) -> str:
    """The check digits of an IBAN, by the remainder by 97."""
    return f"{98 - int(''.join(str(int(c, 36)) for c in f'{rest}{country}00')) % 97:02d}"


def _ssn_place(digits: str) -> int | None:
    """Number of an SSN among those that may be given out, or None."""
    area, group, serial = int(digits[:3]), int(digits[3:5]), int(digits[5:])
    if not (0 < area < 900 and area != 666 and group and serial):
        return None
    return ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1


def _ssn(place: int) -> str:
    place, serial = divmod(place, 9999)
    area, group = divmod(place, 99)
    return f"{area + 1 + (area >= 665):03d}{group + 1:02d}{serial + 1:04d}"


@lru_cache(maxsize=50_000)
def surrogate(key: bytes, kind: str, value: str, attempt: int = 0) -> str:
    """The surrogate of a normal value, in the same normal form."""
    tweak = f"{kind}#{attempt}"
    if kind == "given":  # the next one of the ring: one-to-one, and never itself
        names = _ring(key, GIVEN[value])
        return names[(names.index(value) + 1) % len(names)]
    if kind == "email":
        local, domain = value.split("@", 1)
        body, top = domain.rsplit(".", 1)
        changed = local + "@" + body
        made, at = _swap(key, tweak, changed, _by_class(changed)), len(local)
        return made[:at] + _grown(key, kind, value, attempt) + made[at:] + "." + top
    if kind == "ip6":  # the first group and the layout stay
        head, rest = value.split(":", 1)
        lead = [i == 0 or rest[i - 1] == ":" for i in range(len(rest))]
        return head + ":" + _swap(key, tweak + head, rest, ["" if c == ":" or c == "0" and first else _HEX[1:] if first else _HEX for c, first in zip(rest, lead)])
    if kind == "ip":
        octets = [int(x) for x in value.split(".")]
        number = 0
        for x in octets:
            number = number * 256 + x
        while True:  # stay among unicast addresses, as those that are found usually are
            number = permute(key, tweak, number, 1 << 32)
            out = [number >> s & 255 for s in (24, 16, 8, 0)]
            if 0 < out[0] < 224 or not 0 < octets[0] < 224:
                return ".".join(map(str, out))
    if kind == "card":
        digits = [int(c) for c in value]
        checked = luhn_digit(digits[:-1]) == digits[-1]
        changed = value[1:-1] if checked else value[1:]
        out = value[0] + _swap(key, tweak, changed, _by_class(changed))
        return out + str(luhn_digit([int(c) for c in out])) if checked else out
    if kind == "phone":
        country, digits = value.split("|")
        if country[-1:] == "0":  # an area code begins with another digit
            return country + "|" + _swap(key, tweak, digits, ["123456789" if i == 0 else _CLASS[c] for i, c in enumerate(digits)])
        return country + "|" + _swap(key, tweak, digits, ["23456789" if c in "23456789" and i in (0, 3) and len(digits) == 10 else _CLASS[c] for i, c in enumerate(digits)])
    if kind == "ssn":
        place = _ssn_place(value)
        if place is not None:
            return _ssn(permute(key, tweak, place, 898 * 99 * 9999))
        while True:  # what is no SSN stays none
            value = _swap(key, tweak, value, _by_class(value))
            if _ssn_place(value) is None:
                return value
    if kind == "aws_key":
        return value[:4] + _swap(key, tweak, value[4:], [_BASE36] * (len(value) - 4))
    if kind == "iban":
        if iban_check(value[:2], value[4:]) == value[2:4]:
            rest = _swap(key, tweak, value[4:], ["0123456789" if c.isdigit() else _BASE36[:26] for c in value[4:]])
            return value[:2] + iban_check(value[:2], rest) + rest
        return value[:2] + _swap(key, tweak, value[2:], ["0123456789" if c.isdigit() else _BASE36[:26] for c in value[2:]])
    if kind == "token":
        cut = value.index("_") + 1 if value[:2] == "gh" else value.index("-") + 1 if "-" in value[:5] else 3
        return value[:cut] + _swap(key, tweak, value[cut:], _mixed_secret(value[cut:]))
    if kind == "secret":
        return _swap(key, tweak, value, _mixed_secret(value)) + _grown(key, kind, value, attempt)
    return _swap(key, tweak, value, _by_class(value)) + _grown(key, kind, value, attempt)  # surname


def _render(kind: str, text: str, parts: list[str]) -> str:
    """Put surrogate parts back into the layout of the text that was found."""
    if kind == "name":
        m = _HEAD.fullmatch(text)
        parts = list(parts)
        out = text[: m.start("last")]
        if m["given"]:
            out = text[: m.start("given")] + parts.pop(0) + text[m.end("given") : m.start("last")]
        pieces = _SEPARATOR.split(m["last"])
        return out + "".join(parts.pop(0) if p and not i % 2 else p for i, p in enumerate(pieces))
    if kind in ("phone", "card", "iban", "ssn"):
        chars = iter(parts[0].split("|")[-1])
        if kind == "phone":
            return _country(text) + "".join(next(chars) if c.isdigit() else c for c in _local(text))
        return "".join(next(chars) if c.isalnum() else c for c in text)
    return parts[0]


def _phone(text: str) -> bool:
    """National numbers have nine digits at least, so that dates and counts are none."""
    return text[0] == "+" or not re.match(r"\(?0", text) or 9 <= sum(c.isdigit() for c in text) <= 13


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, type) of the entities of a text, apart from each other and in order."""
    out = []
    alone: dict[str, str] = {}
    for m in _ANY.finditer(text):
        kind = next(k for k in _NAMES_OF_KINDS if m[k] is not None)
        if kind == "secret":
            if m["secret_value"].strip("._-/+=").isalpha():  # a word, not a secret
                continue
            out.append((m.start("secret_value"), m.end("secret_value"), kind))
        elif kind == "card" and luhn_digit([int(c) for c in m[0] if c.isdigit()][:-1]) != int(m[0][-1]):
            continue
        elif kind == "phone" and not _phone(m[0]) or kind == "ip6" and not any(c.isdigit() for c in m[0]):
            continue
        elif kind == "name":
            a, b = m.span("intro_name") if m["intro_name"] else m.span()
            out.append((a, b, kind))
            alone |= {v: k for k, v in normal("name", text[a:b]) if len(v) > 2}
        else:
            out.append((m.start(), m.end(), kind))
    if alone:
        again = re.compile(r"(?<![\w'’-])(?:" + "|".join(map(re.escape, sorted(alone, key=len, reverse=True))) + r")(?![\w'’-])")
        edges = [0, *(x for a, b, _ in out for x in (a, b)), len(text)]
        more = [(m.start(), m.end(), alone[m[0]]) for a, b in zip(edges[::2], edges[1::2]) for m in again.finditer(text, a, b)]
        out = sorted(out + more) if more else out
    return out


_NAMES_OF_KINDS = [k for k, _ in _KINDS]
_SHOWN = {"given": "name", "surname": "name", "ip6": "ip"}


def replace(text: str, key: bytes, attempts: dict[tuple[str, str], int]) -> tuple[str, list[str]]:
    """The text with surrogates, and the types found in order."""
    found = find(text)
    parts, at = [], 0
    for start, end, kind in found:
        was = text[start:end]
        new = [surrogate(key, k, v, attempts.get((k, v), 0)) for k, v in normal(kind, was)]
        parts += [text[at:start], _render(kind, was, new)]
        at = end
    return "".join([*parts, text[at:]]), [_SHOWN.get(k, k) for *_, k in found]


register("pii", surrogate.cache_clear)


def _likely(texts: pa.Array) -> list[int]:
    claim("pii")
    mask = pc.match_substring_regex(texts.cast(pa.large_string()), _MAYBE).fill_null(False)
    return pc.indices_nonzero(mask).to_pylist()


def entities(docs: DataFrame) -> DataFrame:
    """Distinct (type, value) parts of all texts, with equal ones merged before the shuffle."""

    text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            seen = set()
            for i in _likely(texts):
                text = texts[i].as_py()
                for a, b, kind in find(text):
                    seen.update(normal(kind, text[a:b]))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in seen], pa.string()), pa.array([v for _, v in seen], pa.string())], ["type", "value"])

    return docs.select("text").mapInArrow(run, "type string, value string").distinct()


def _with_surrogates(table: DataFrame, key: bytes) -> DataFrame:
    def make(kind: pa.Array, value: pa.Array, attempt: pa.Array) -> pa.Array:
        return pa.array([surrogate(key, *x) for x in zip(kind.to_pylist(), value.to_pylist(), attempt.to_pylist())], pa.string())

    return table.withColumn("surrogate", F.arrow_udf(make, T.StringType())("type", "value", "attempt"))


def resolve(found: DataFrame, key: bytes) -> DataFrame:
    """(type, value, attempt, surrogate) such that no surrogate is real or shared.

    Each round keys only the entities in conflict again. Given names are exempt: they are
    public words, and map one-to-one within their list. A corpus that uses up a format which
    cannot grow is an error.
    """
    base = found.filter("type <> 'given'")
    table = materialize(_with_surrogates(base.withColumn("attempt", F.lit(0)), key), "entities")
    real = table.select("type", F.col("value").alias("surrogate")).distinct()
    for _ in range(MAX_ATTEMPTS):
        taken = table.join(real, ["type", "surrogate"], "left_semi").select("type", "value")
        first = table.groupBy("type", "surrogate").agg(F.min("value").alias("keeper"), F.count("*").alias("n")).filter("n > 1")
        shared = table.join(first, ["type", "surrogate"]).filter("value <> keeper").select("type", "value")
        bad = materialize(taken.unionByName(shared).distinct(), "conflicts")
        if bad.isEmpty():
            return table
        again = table.join(bad, ["type", "value"], "left_semi").withColumn("attempt", F.col("attempt") + 1).drop("surrogate")
        table = materialize(table.join(bad, ["type", "value"], "left_anti").unionByName(_with_surrogates(again, key)), "entities")
    types = sorted(r.type for r in bad.select("type").distinct().collect())  # at most one row a type
    raise RuntimeError(f"the corpus uses up the formats of {', '.join(types)}")


_RESULT = "struct<text:string,types:array<string>>"


_drawn: dict[str, bytes] = {}


def session_key(spark: SparkSession) -> bytes:
    """The session's key, or a random one that lasts as long as the application."""
    given = spark.conf.get("spark.graphloom.surrogateKey", None)
    return bytes.fromhex(given) if given else _drawn.setdefault(spark.sparkContext.applicationId, secrets.token_bytes(32))


def pseudonymise(docs: DataFrame, key: bytes | None = None, broadcast_rows: int = BROADCAST_ROWS, column: str = "pii_types") -> DataFrame:
    """``docs`` with surrogates in ``text`` and the types found, in order, in ``column``; the session's key without one."""
    key = session_key(docs.sparkSession) if key is None else key
    odd = materialize(resolve(entities(docs), key).filter("attempt > 0").select("type", "value", "attempt"), "rekeyed")
    kind = T.StructType([T.StructField("text", T.StringType()), T.StructField("types", T.ArrayType(T.StringType()))])
    arrow = pa.struct([("text", pa.string()), ("types", pa.list_(pa.string()))])

    def apply(texts: pa.Array, attempts: Iterator[dict]) -> pa.Array:
        new, types = texts.to_pylist(), [[] for _ in range(len(texts))]
        tables = list(attempts)
        for i in _likely(texts):
            new[i], types[i] = replace(new[i], key, tables[i] if len(tables) > 1 else tables[0])
        return pa.StructArray.from_arrays([pa.array(new, pa.string()), pa.array(types, pa.list_(pa.string()))], fields=list(arrow))

    (made,) = free_names(docs.columns, "_made")
    few = odd.limit(broadcast_rows + 1).count() <= broadcast_rows
    if few:
        known = {(r.type, r.value): r.attempt for r in odd.collect()}

        def all_known(texts: pa.Array) -> pa.Array:
            return apply(texts, [known])

        out = docs.withColumn(made, F.arrow_udf(all_known, kind)("text"))
    else:
        out = _joined(docs, odd, apply, kind, made)
    names = [F.col(f"{made}.text").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    return out.select(*names, F.col(f"{made}.types").alias(column))


def _joined(docs: DataFrame, odd: DataFrame, apply, kind: T.DataType, made: str) -> DataFrame:
    """The way without a broadcast: each document meets the attempts of its own entities."""

    def parts(texts: pa.Array) -> pa.Array:
        out: list[list[str]] = [[] for _ in range(len(texts))]
        for i in _likely(texts):
            text = texts[i].as_py()
            out[i] = sorted({"\x1f".join(p) for a, b, k in find(text) for p in normal(k, text[a:b])})
        return pa.array(out, pa.list_(pa.string()))

    uid, own_odd = free_names([*docs.columns, made], "_uid", "_odd")
    rows = materialize(docs.withColumn(uid, F.monotonically_increasing_id()), "pii-docs")
    need = rows.select(F.col(uid).alias("uid"), F.explode(F.arrow_udf(parts, T.ArrayType(T.StringType()))("text")).alias("part"))
    odd = odd.select(F.concat_ws("\x1f", "type", "value").alias("part"), "attempt")
    own = join_unique(materialize(need, "pii-parts"), odd, ["part"])
    own = own.groupBy(F.col("uid").alias(uid)).agg(F.map_from_entries(F.collect_list(F.struct("part", "attempt"))).alias(own_odd))

    def one(texts: pa.Array, tables: pa.Array) -> pa.Array:
        maps = [{tuple(k.split("\x1f", 1)): v for k, v in (m or [])} for m in tables.to_pylist()]
        return apply(texts, maps if len(maps) > 1 else maps or [{}])

    joined = rows.join(own, uid, "left")
    return joined.withColumn(made, F.arrow_udf(one, kind)("text", own_odd)).drop(own_odd, uid)
