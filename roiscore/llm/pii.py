"""Surrogates for personal data: keyed, type-consistent replacements that keep format, script and gender."""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import unicodedata
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roiscore.llm.common import cut, give_back, id_and_text, with_carried

#: Given names and entities that needed a second try (some 50 bytes each), at most, which are broadcast; above it they are joined.
MOST_BROADCAST = 100_000
_NULL_ID = (1 << 63) - 1

# Titles before names, by gender.
MALE_TITLES = ("Mr", "Sir", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Господин", "Κύριος")
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mlle", "Señora", "Señorita", "Sra", "Srta", "Госпожа", "Κυρία")
OTHER_TITLES = ("Dr", "Prof", "Professor", "Professeur", "Doctor")

# Words in capitals that end a name in capitals.
CAPITAL_STOPS = frozenset("A AM AN AND ARE AS AT BE BUT BY DE DER DIE DU EL EN EST ET FOR FROM HAD HAS HAVE HE I IN IS IT LA LE NOT O OF ON OR OU SAID SHE THAT THE THEY TO UND WAS WE WHO WILL WITH Y YOU".split())
# How given names end in scripts beside Latin.
ENDINGS = {"CYRILLIC": {"m": "нрт", "f": "ая"}, "GREEK": {"m": "ς", "f": "αη"}}

# Country calling codes of one and of two digits; all others have three.
SHORT_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_DIGITS = re.compile(
    rf"(?P<IP>(?<![\w.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?\w))"
    r"|(?P<SSN>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])|(?:(?<=SSN )|(?<=SSN: )|(?<=SSN:)|(?<=SSN# )|(?<=Social Security Number )|(?<=social security number ))\d{9}(?!\w))"
    r"|(?P<PHONE>(?<![\w.+(])(?:\+?\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\w)|(?<![\w.+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\w)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])|(?<![\w.,+/-])0[1-9]\d{1,3}[ /-](?:\d{6,8}|\d{2,4}(?:[ -]\d{2,4}){1,3})(?![\w-]))"
)
_IP6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:]|\.\w)")
_GROUP = re.compile(r"\d+")
_GROUPS = re.compile(r"(?<![\w-])\d+(?:[ -]\d+)*(?![\w-])")  # of digits; a card may stand among others
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
_DOMAIN = re.compile(r"@[^\W_](?:[\w-]*[^\W_])?(?:\.[^\W_](?:[\w-]*[^\W_])?)*\.[^\W\d_]{2,}")
_LOCAL = re.compile(r"[\w.%+'-]")
_RUN = re.compile(r"\w+")
_TITLES = frozenset(f(t) for t in MALE_TITLES + FEMALE_TITLES + OTHER_TITLES for f in (str, str.upper))
_TITLE = re.compile(r"\b(" + "|".join(sorted(_TITLES)) + r")\b(?:\.(?=[^\W\d_])|\.?(?= +[^\W\d_]))")
# A name word follows blanks, or the stop of a title or an initial.
_NAME = re.compile(r"(?: +|(?<=[^\W\d_]\.))([^\W\d_](?:[\w'’-]*\w)?)(?!\w)")
_PREFIXED = re.compile(r"[^\W\d_]{1,5}['’-][^\W\d_]")  # d'Artagnan, al-Rashid
# Particles within names; articles and contractions that prose has before nouns, too, only after another particle or right after the title.
_PARTICLE = r"von|van|de|del|della|dello|degli|dei|di|da|dal|do|dos|du|af|av|zu|bin|bint|ibn|ben|abu|al|el|la|le|lo|ter|ten|te|y|e|i"
_ARTICLE = r"der|den|dem|des|das|die|het|las|los|les|und|vom|zum|zur|['’]t"
_PARTICLES = re.compile(rf"(?: +(?:{_PARTICLE})(?: +(?:{_PARTICLE}|{_ARTICLE}))*)(?= )")
_FIRST_PARTICLES = re.compile(rf"(?: +(?:{_PARTICLE}|{_ARTICLE}))+(?= )")
_GENDER = {t: g for g, titles in (("m", MALE_TITLES), ("f", FEMALE_TITLES)) for title in titles for t in (title, title.upper())}

Span = tuple[int, int, str, str, str]  # start, end, kind, canonical form, style (of names: s surname, or m, f, n given name)


def _luhn(digits: str) -> int:
    """The sum that is a multiple of ten for a valid number."""
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits))))


def _iban_rest(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def _name_words(text: str, at: int, capitals: bool = False) -> list[tuple[re.Match, bool]]:
    """The name words from here on to their end, and whether each is a surname wherever it stands: after a particle, or the third or later.

    Scripts without case do not show where a name ends, nor do texts in capitals; so there no word after the third is taken, and
    in capitals none from a common word on.
    """
    tokens: list[tuple[re.Match, bool]] = []
    while True:
        particles = (_PARTICLES if tokens else _FIRST_PARTICLES).match(text, at)
        t = _NAME.match(text, particles.end() if particles else at)
        if not t or t[1] in _TITLES or not (t[1][0].isupper() or len(tokens) < 3 and unicodedata.category(t[1][0]) == "Lo" or (p := _PREFIXED.match(t[1])) and p[0][-1].isupper()):
            return tokens
        if capitals and t[1].isupper() and (len(tokens) == 3 or t[1] in CAPITAL_STOPS):
            return tokens
        at = t.end()
        initial = len(t[1]) == 1 and t[1].isupper() and text[at : at + 1] == "."
        at += initial
        tokens.append((t, bool(particles) or len(tokens) > 1 and not initial))


def _card_like(sizes: list[int], digits: str) -> bool:
    """Whether groups of digits that stand beside others look like a card: 4-4-4-4 with a shorter or a further last group, 4-6-4, 4-6-5, or one group, from 3 to 6 on."""
    fours = len(sizes) in (4, 5) and {*sizes[:-1]} == {4} and sizes[-1] <= 4
    return digits[0] in "3456" and (len(sizes) == 1 or fours or sizes in ([4, 6, 4], [4, 6, 5]))


def _cards(text: str, at: int, end: int) -> Iterator[tuple[int, int, str]]:
    """(start, end, digits) of the valid card numbers in a run of groups of digits, from the left, the longest first: the whole run, or what looks like a card within it.

    A card has 13 to 19 digits, so every group starts few attempts.
    """
    groups = [m.span() for m in _GROUP.finditer(text, at, end)]
    i = 0
    while i < len(groups):
        ends, digits = [], ""
        for j in range(i, len(groups)):
            digits += text[slice(*groups[j])]
            if len(digits) > 19:
                break
            whole = i == 0 and j == len(groups) - 1
            if len(digits) >= 13 and (whole or _card_like([b - a for a, b in groups[i : j + 1]], digits)) and _luhn(digits) % 10 == 0 and digits.strip("0"):
                ends.append((j, digits))
        if ends:
            j, digits = ends[-1]
            yield groups[i][0], groups[j][1], digits
            i = j
        i += 1


def _iban(text: str) -> str:
    """The valid IBAN that a run of groups begins with, as it stands: words in capitals may follow. Empty if there is none."""
    while text:
        plain = text.replace(" ", "")
        if 15 <= len(plain) <= 34 and plain.isascii() and _iban_rest(plain) == 1:
            return text
        text = text.rpartition(" ")[0]
    return ""


def _address(text: str) -> str:
    """The canonical form of an IPv6 address of three groups or more, or of two of which the first has four digits; empty for anything else, such as a time of day or a scope in code."""
    groups = [g for g in text.split(":") if g]
    if len(groups) < 2 or len(groups) == 2 and not (len(groups[0]) == 4 and any(map(str.isdigit, groups[0]))):
        return ""
    try:
        return ipaddress.IPv6Address(text).compressed
    except ValueError:
        return ""


def _national(number: str) -> str:
    """The digits of a phone number without country code and trunk zero, which are one in all its forms."""
    digits = re.sub(r"\D", "", number)
    if number.startswith("+"):
        code = next((k for k in (1, 2) if digits[:k] in SHORT_CODES), 3)
    else:  # a number before the brackets is a country code
        code = len(re.sub(r"\D", "", number.partition("(")[0])) if "(" in number else 0
    return digits[code:].lstrip("0") or digits[-1:]


def _with(kept: list[Span], more: list[Span]) -> list[Span]:
    """kept, and those of more that overlap none of it nor one another (of these the first stays); both by start."""
    out: list[Span] = []
    at, end = 0, 0
    for span in more:
        while at < len(kept) and kept[at][1] <= span[0]:
            at += 1
        if span[0] >= end and (at == len(kept) or span[1] <= kept[at][0]):
            out.append(span)
            end = span[1]
    return sorted(kept + out)


def _mentions(text: str, names: dict[str, tuple[str, str]]) -> list[Span]:
    """Where names stand as whole words; the longest of those that start at one place."""
    by_run: dict[str, list[str]] = {}
    for name in sorted(names, key=len, reverse=True):
        by_run.setdefault(_RUN.match(name)[0], []).append(name)
    found, end = [], 0
    for m in _RUN.finditer(text):
        if m.start() >= end:
            for name in by_run.get(m[0], ()):
                end = m.start() + len(name)
                if text.startswith(name, m.start()) and not (text[end : end + 1] == "_" or text[end : end + 1].isalnum()):
                    found.append((m.start(), end, "NAME", *names[name]))
                    break
            else:
                end = m.end()
    return found


def detect(text: str) -> list[Span]:
    """Entities in order of their places; of overlapping ones the first found of e-mail, IBAN, address or phone or security number, card, name stays. Linear in the text but for sorting."""
    kept: list[Span] = []
    if "@" in text:
        mails = []
        for m in _DOMAIN.finditer(text):
            start = m.start()
            while start and _LOCAL.match(text[start - 1]):
                start -= 1
            if start < m.start():
                mails.append((start, m.end(), "EMAIL", text[start : m.end()].lower(), ""))
        kept = _with(kept, mails)
    if re.search(r"\d", text):
        ibans = []
        for m in _IBAN.finditer(text):
            if own := _iban(m[0]):
                ibans.append((m.start(), m.start() + len(own), "IBAN", own.replace(" ", ""), ""))
        kept = _with(kept, ibans)
        numbers = []
        for m in _DIGITS.finditer(text):
            kind = m.lastgroup
            numbers.append((*m.span(), kind, m[0] if kind == "IP" else _national(m[0]) if kind == "PHONE" else re.sub(r"\D", "", m[0]), ""))
        kept = _with(kept, numbers)
        kept = _with(kept, [(a, b, "CARD", digits, "") for m in _GROUPS.finditer(text) for a, b, digits in _cards(text, *m.span())])
    if text.count(":") > 1:
        kept = _with(kept, [(*m.span(), "IP6", own, "") for m in _IP6.finditer(text) if (own := _address(m[0]))])
    titled: list[Span] = []
    names: dict[str, tuple[str, str]] = {}
    for m in _TITLE.finditer(text):
        tokens = _name_words(text, m.end(), len(m[1]) > 1 and m[1].isupper())
        for k, (t, family) in enumerate(tokens):
            style = "s" if family or k == len(tokens) - 1 else _GENDER.get(m[1], "n")
            titled.append((*t.span(1), "NAME", t[1].casefold(), style))
            if len(t[1]) > 1 or style == "s":  # an initial is no name elsewhere
                names[t[1]] = (t[1].casefold(), style)
    if titled:  # and later mentions without a title
        kept = _with(_with(kept, titled), _mentions(text, names))
    return kept


class _Digits:
    """Numbers drawn from a keyed hash of an entity."""

    def __init__(self, key: bytes, *parts: str):
        self.key, self.seed, self.block, self.left = key, "\x1f".join(parts).encode(), 0, 0

    def below(self, n: int) -> int:
        if self.left < 1 << 64:
            self.left = int.from_bytes(hmac.new(self.key, self.seed + self.block.to_bytes(4, "big"), hashlib.sha256).digest(), "big")
            self.block += 1
        self.left, rest = divmod(self.left, n)
        return rest


_CONSONANTS, _VOWELS = "bcdfghjklmnprstvwz", "aeiou"


def _letter(c: str, draw: _Digits) -> str:
    """Another letter of the same case and script; letters beside Latin keep their block of 32 code points."""
    low = c.lower()
    if low.isascii() or unicodedata.name(low, "").startswith("LATIN"):
        new = (_VOWELS if unicodedata.normalize("NFD", low)[0] in _VOWELS else _CONSONANTS)
        new = new[draw.below(len(new))]
    else:
        block = [x for x in map(chr, range(ord(low) & ~31, (ord(low) | 31) + 1)) if unicodedata.category(x) == unicodedata.category(low)]
        new = block[draw.below(len(block))]
    return new.upper() if c.isupper() and len(new.upper()) == 1 else new


def _shaped(text: str, draw: _Digits) -> str:
    return "".join(str(draw.below(10)) if c.isdigit() else _letter(c, draw) if c.isalpha() else c for c in text)


#: Attempts after which a kind's own range counts as full, and a wider one is drawn from; a number of few digits has few others, and is widened sooner.
NARROW_TRIES, FEW_TRIES, FEW_DIGITS = 8, 2, 7


def _more(kind: str, canonical: str, attempt: int) -> int:
    """Digits by which a replacement is longer than its range: none at first, then one more with every attempt, so that no number of entities fills all of them."""
    return max(0, attempt + 1 - (FEW_TRIES if kind == "PHONE" and len(canonical) < FEW_DIGITS else NARROW_TRIES * (2 if kind == "IP" else 1)))


def surrogate(key: bytes, kind: str, canonical: str, attempt: int = 0, style: str = "s") -> str:
    """The canonical form of an entity's replacement; a later attempt gives another one. style: that of a name."""
    draw = _Digits(key, kind, canonical, str(attempt))
    more = _more(kind, canonical, attempt)
    if kind == "EMAIL":
        local, _, domain = canonical.rpartition("@")
        labels = domain.split(".")[:-1]
        own = [_shaped(x, _Digits(key, "DOMAIN", domain, str(i))) for i, x in enumerate(labels)]
        return f"{_shaped(local, draw)}{draw.below(10) if attempt else ''}{_tail(draw, more)}@{'.'.join(own)}.example"
    if kind == "IP":  # reserved addresses; private ones stay in their private range
        first, second = canonical.split(".")[:2]
        fixed = [first] if first in ("10", "127") else ["192", "168"] if (first, second) == ("192", "168") else ["172", str(16 + draw.below(16))] if first == "172" and 16 <= int(second) < 32 else []
        if not fixed or attempt >= NARROW_TRIES:
            fixed = [str(240 + draw.below(16))]
        return ".".join(fixed + [str(draw.below(256)) for _ in range(4 - len(fixed))]) + ("." + _tail(draw, more) if more else "")
    if kind == "IP6":  # the range of documentation
        return ipaddress.IPv6Address((0x20010DB8 << 96) + draw.below(1 << 96)).compressed + _tail(draw, more)
    if kind == "SSN":  # area numbers from 900 on are never given out
        return f"9{draw.below(100):02d}{draw.below(10**6):06d}{_tail(draw, more)}"
    if kind == "PHONE":
        return "".join(str(draw.below(10) if c == "0" else 1 + draw.below(9)) for c in canonical) + _tail(draw, more)
    if kind == "CARD":  # five zeros after the network's digit: numbers as in documentation, not given out
        zeros = 5 if attempt < NARROW_TRIES else 2
        body = canonical[0] + "0" * zeros + "".join(str(draw.below(10)) for _ in canonical[2 + zeros :]) + _tail(draw, more)
        return body + str(-_luhn(body + "0") % 10)
    if kind == "IBAN":
        body = "".join(str(draw.below(10)) if c.isdigit() else chr(65 + draw.below(26)) for c in canonical[4:]) + _tail(draw, more)
        return f"{canonical[:2]}{98 - _iban_rest(canonical[:2] + '00' + body):02d}{body}"
    if canonical.isalpha() and not all(unicodedata.name(c, "").startswith("LATIN") for c in canonical):
        new = _shaped(canonical, draw) + "".join(_letter(canonical[-1], draw) for _ in range(attempt))
        ending = ENDINGS.get(unicodedata.name(canonical[-1], "").partition(" ")[0], {}).get(style)
        return new[:-1] + ending[draw.below(len(ending))] if ending and len(new) > 1 else new
    name = "".join(_CONSONANTS[draw.below(18)] + _VOWELS[draw.below(5)] for _ in range(2 + (style == "s") + attempt))
    ending = {"m": ("n", "rt", "s", "k"), "f": ("na", "la", "ria", "sa"), "n": ("l", "m", "r", "n")}.get(style, ("ng", "rs", "lt", "nd", "ck", "ller", "tov", "mann"))
    return name + ending[draw.below(len(ending))]


def _tail(draw: _Digits, n: int) -> str:
    return "".join(str(draw.below(10)) for _ in range(n))


def _laid(surface: str, kind: str, canonical: str, new: str) -> str:
    """The replacement in the format of this mention: its separators, and its case for names; what it is longer than the entity comes last."""
    if kind in ("PHONE", "CARD", "SSN", "IBAN"):
        before = sum(map(str.isalnum, surface)) - len(canonical)  # a phone number's country code and trunk zero stay
        rest = iter([c for c in surface if c.isalnum()][:before] + [*new])
        return "".join([next(rest) if c.isalnum() else c for c in surface] + [*rest])
    if kind == "NAME":
        return new.upper() if len(surface) > 1 and surface.isupper() else new[:1].upper() + new[1:] if surface[:1].isupper() else new
    return new.upper() if kind in ("EMAIL", "IP6") and surface.isupper() else new


@dataclass(frozen=True)
class Policy:
    """The key that replacements depend on; without it they can't be linked to the entities."""

    key: bytes


def _rewrite(text: str, policy: Policy, tries: dict[tuple[str, str], tuple[int, str]]) -> tuple[str, list[dict]]:
    out, at, spans = [], 0, []
    for start, end, kind, canonical, _ in detect(text):
        new = _laid(text[start:end], kind, canonical, surrogate(policy.key, kind, canonical, *tries.get((kind, canonical), (0, "s"))))
        out += [text[at:start], new]
        spans.append({"start": start, "end": end, "kind": kind, "surrogate": new})
        at = end
    return ("".join([*out, text[at:]]) if spans else text), spans


def _styled(found: DataFrame) -> DataFrame:
    """(kind, canonical, style): one row for each entity. A name that is anywhere a given name has that style everywhere, with a gender if all its gendered titles agree."""
    has = {s: F.max((F.col("style") == s).cast("int")) == 1 for s in "mfn"}
    style = F.when(has["m"] & ~has["f"], "m").when(has["f"] & ~has["m"], "f").when(has["m"] | has["n"], "n").otherwise("s")
    return found.groupBy("kind", "canonical").agg(style.alias("style"))


def _tries(entities: DataFrame, policy: Policy) -> DataFrame:
    """(kind, canonical, attempt, style) of the entities that do not simply have their first replacement: given names, and those whose first
    replacement is another entity's, or is an entity itself.

    Of entities with one replacement the smallest keeps it; the others, and those whose replacement stands in the corpus,
    draw again until every replacement is its entity's own. That ends whatever the entities are: where a kind's range is
    full, replacements get longer with every attempt.
    """

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([surrogate(policy.key, *x) for x in rows], pa.string())], names=["kind", "canonical", "attempt", "style", "new"])

    schema = "kind string, canonical string, attempt int, style string, new string"
    now = cut(entities.select("kind", "canonical", F.lit(0).alias("attempt"), "style").mapInArrow(draw, schema))
    while True:
        taken = now.groupBy("kind", "new").agg(F.min("canonical").alias("owner"), F.count("*").alias("n")).where("n > 1").select("kind", "new", "owner")
        doubled = now.join(taken, ["kind", "new"]).where("canonical <> owner").select("kind", "canonical")
        real = now.join(entities.select("kind", F.col("canonical").alias("new")), ["kind", "new"]).select("kind", "canonical")
        again = cut(doubled.union(real).distinct())
        if again.isEmpty():
            return now.where("attempt > 0 or style <> 's'").select("kind", "canonical", "attempt", "style")
        redrawn = now.join(again, ["kind", "canonical"], "left_semi").select("kind", "canonical", (F.col("attempt") + 1).alias("attempt"), "style").mapInArrow(draw, schema)
        now = cut(now.join(again, ["kind", "canonical"], "left_anti").unionByName(redrawn))


def replace_entities(docs: DataFrame, policy: Policy, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] | None = None) -> DataFrame:
    """(doc_id, text, entities): texts with their personal data replaced, and where it stood (characters), its kind and its replacement.

    Kinds: e-mail addresses, phone numbers, IPv4 and IPv6 addresses, payment cards (valid check digit), IBANs (valid), social
    security numbers, and names after a title. Replacements depend on the key, the kind and the canonical form (and a name's style in the
    corpus), so one entity has one replacement in all documents and formats: a phone number with and without its country
    code, a name under any title and, in a text that has it with one, without. They keep separators, case, script, country codes, length
    where the kind has one, valid check digits, and the gender that a given name's titles tell. They lie in ranges
    that are not given out, where the kind has such. No two entities share a replacement, and none is an entity of the corpus.

    Texts are read twice, for the distinct entities and for the replacement, and are not shuffled as long as given names and entities with a
    second draw are few (counted). Null or empty texts stay empty, without entities; rows with equal or null ids are kept; texts without
    entities are returned as they are; an empty table gives no rows; extra columns are not read, but those in `carry` go
    along as the struct column `carried`.
    """
    docs = id_and_text(docs, id_col, text_col, carry).withColumn("doc_id", F.coalesce("doc_id", F.lit(_NULL_ID))).withColumnRenamed("doc_id", "key")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            distinct = {s[2:] for text in batch.column(0).to_pylist() for s in detect(text)}
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in distinct], pa.string()) for i in range(3)], names=["kind", "canonical", "style"])

    entities = cut(_styled(docs.select("text").mapInArrow(found, "kind string, canonical string, style string")))
    tries = cut(_tries(entities, policy))
    few = tries.count() <= MOST_BROADCAST
    known = docs.sparkSession.sparkContext.broadcast({(r.kind, r.canonical): (r.attempt, r.style) for r in tries.toLocalIterator()} if few else {})

    def mentioned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {(key, *s[2:4]) for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for s in detect(text)}
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string()))], names=["key", "kind", "canonical"])

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("surrogate", pa.string())]))
        for batch in batches:
            own = batch.column("own").to_pylist() if not few else [None] * batch.num_rows
            carried = [c for c in batch.schema.names if c == "carried"]
            rows = [_rewrite(t, policy, {(x["kind"], x["canonical"]): (x["attempt"], x["style"]) for x in o} if o else known.value) for t, o in zip(batch.column(1).to_pylist(), own)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], span), *map(batch.column, carried)], names=["key", "text", "entities", *carried])
            del rows
            give_back()

    asked = docs
    if not few:
        own = docs.select("key", "text").mapInArrow(mentioned, "key long, kind string, canonical string").distinct().join(tries, ["kind", "canonical"])
        asked = docs.join(own.groupBy("key").agg(F.collect_list(F.struct("kind", "canonical", "attempt", "style")).alias("own")), "key", "left").select("key", "text", "own", *docs.columns[2:])
    done = asked.mapInArrow(rewrite, with_carried("key long, text string, entities array<struct<start: long, end: long, kind: string, surrogate: string>>", docs))
    return done.withColumn("key", F.nullif("key", F.lit(_NULL_ID))).withColumnRenamed("key", "doc_id")
