"""Personal information inside free text: detection, and keyed surrogates in typed placeholders.

Method: surrogate generation. Detected entities are replaced by keyed surrogates of the same type and format. A part of a
person's name gets a made-up name of its script, gender and case; the names drawn for all different parts of the corpus are
joined to find collisions, which are drawn again. Everything else gets a bijection within its format (each character is
moved, within its class, by a keyed hash of what stands before it), whose surrogates can't collide. The same part, number or
address has the same surrogate everywhere.

Detection is rules over each whole text: e-mail addresses (plain and disguised), numbers issued to a person (a shape next to a label),
phone numbers, street addresses and postal boxes, names of persons. Words that can't begin a match leave by one look-up, the
full patterns run around the rest. Names use two word lists counted over all texts in one
pass: words that follow the cues of names, and common words.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A word is common from this share of all words on (so there are at most 1 / COMMON_SHARE of them) unless that is its use as
#: a surname, a given name if it
#: follows a cue at least NAME_COUNT times and in NAME_SHARE of its occurrences; LIST_WORDS bounds what reaches the driver.
COMMON_SHARE, NAME_COUNT, NAME_SHARE, LIST_WORDS = 5e-5, 3, 0.15, 20_000
COUNTER_WORDS = 200_000

# Words around names, numbers and addresses in English, German, French and Spanish.
TITLES = ("Dr", "Prof", "Mr", "Mrs", "Ms", "Miss", "Herr", "Frau", "Mme", "Mlle", "M", "Sr", "Sra", "Dra", "Don", "Doña", "Sir", "Madame", "Monsieur", "Señor", "Señora")
PARTICLES = ("van", "von", "de", "der", "den", "da", "di", "del", "della", "la", "le", "du", "dos", "ter", "ten", "bin", "ibn", "al", "el", "zu")
LEFT_CUES = (
    "ask", "ask for", "asked", "according to", "write to", "cc", "c/o", "regards", "regards,", "thanks", "thanks,", "thank you", "merci", "danke", "gracias", "hi", "hello",
    "hallo", "hola", "bonjour", "dear", "hey", "edited by", "written by", "posted by", "reviewed by", "signed", "signed:", "author", "author:", "maintainer", "maintainer:", "name:", "kontakt:", "contact:",
    "uploaded for", "lists", "i am", "my name is", "ich bin", "je suis", "soy", "both", "no idea,", "user.name", "both", "neighbour", "neighbor", "supervisor", "landlord", "landlady", "co-author", "colleague",
    "sister", "brother", "wife", "husband", "boss", "friend", "mother", "father", "student", "advisor",
)
STREET_WORDS = "street|st|road|rd|avenue|ave|lane|ln|drive|dr|boulevard|blvd|crescent|cres|way|court|ct|place|pl|square|sq|terrace|ter|close|highway|hwy|parkway|pkwy|circle|trail|mews|grove|row"
STREET_FIRST = "rue|avenue|av\\.?|boulevard|bd\\.?|place|chemin|impasse|quai|allée|calle|avenida|avda\\.?|plaza|paseo|camino|carrera|carretera|via|viale|piazza|rua|travessa"
STREET_JOINED = "straße|strasse|str\\.|weg|gasse|allee|platz|ring|damm|ufer|steig|straat|laan|gatan|vägen|vej|gade"
UNITS = r"apt|apartment|unit|suite|ste|flat|floor|fl|room|rm|wohnung|whg|appt|piso|dpto|bldg|building"
BOXES = r"p\.? ?o\.? ?box|post ?box|postfach|apartado(?: postal)?(?: de correos)?|boîte postale|case postale|casilla|locked bag|b\.?p\.?"

LOCAL = r"[\p{L}\p{N}](?:[\p{L}\p{N}._%+\-]*[\p{L}\p{N}_+\-])?"
LABEL_ = r"[\p{L}\p{N}](?:[\p{L}\p{N}\-]*[\p{L}\p{N}])?"
AT, DOT = r"(?:\s?[\[({<]\s?(?:at|@|arroba)\s?[\])}>]\s?|\s(?:at|AT|\(a\)|arroba)\s|\s?@\s?)", r"(?:\s?[\[({<]\s?(?:dot|\.|punkt|point|punto)\s?[\])}>]\s?|\s(?:dot|DOT|punkt|punto)\s|\.)"
EMAIL = regex.compile(rf"(?<![\p{{L}}\p{{N}}._%+\-@])(?:{LOCAL})@{LABEL_}(?:\.{LABEL_})*\.\p{{L}}{{2,24}}(?![\p{{L}}\p{{N}}@]|[.\-][\p{{L}}\p{{N}}])")
DISGUISED = regex.compile(rf"(?<![\p{{L}}\p{{N}}._%+\-@]){LOCAL}(?:{DOT}{LOCAL})?{AT}{LABEL_}(?:{DOT}{LABEL_})*?{DOT}(?:\p{{Ll}}{{2,24}}|\p{{Lu}}{{2,24}})(?:{DOT}(?:\p{{Ll}}{{2,6}}|\p{{Lu}}{{2,6}}))*(?![\p{{L}}\p{{N}}@])")
URL = regex.compile(r"(?:https?|ftp)://[^\s<>\"')\]]+|www\.[^\s<>\"')\]]+")

ID_LABEL = regex.compile(
    r"(?<![\p{L}\p{N}])(?:passport|reisepass(?:nummer)?|pasaporte|passeport|ssn|social (?:security|insurance)(?: number)?|sozialversicherungsnummer|national insurance|national id(?:entity)?(?: card)?|nino|"
    r"health (?:card|insurance|number)|care card|phn|mrn|medical record|nhs|medicare|chart|hospital (?:no|number)|patient (?:id|no|number|#)|participant(?: id| no| number| #)?|subject id|id card|identity card|personnummer|personalausweis(?:nummer)?|"
    r"steuer-?id|versicherungsnummer|versichertennummer|insurance (?:no|number)|insurance|carte (?:vitale|d'identité)|numéro de sécurité sociale|dni|nie|curp|cpf|sin|driver'?s? licen[cs]e|licence no|tax id|itin|member (?:id|no|number))"
    r"(?:\s?(?:no|nr|num|number|nummer|id|card|#)\b)?\s?(?:\.|#|:|=)?(?:\s?[:#=])?",
    regex.I,
)
ID_SHAPE = regex.compile(r"(?<![\p{L}\p{N}\-./])(?:[A-Za-z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Da-d]|\d{3}[- ]\d{2}[- ]\d{4}|\d{6}[-+]\d{4}|\d{4}[ -]\d{3}[ -]\d{3}|\d{3}[ -]\d{3}[ -]\d{3,4}|\d[A-Za-z]-?\d{2,8}|(?=[A-Za-z\-]{0,4}\d)[A-Za-z]{1,3}-?\d{5,10}|[A-Za-z0-9]{1,4}-\d{3,10}|\d{6,12})(?![\p{L}\p{N}\-/]|\.\d)")
ID_ALONE = regex.compile(r"(?<![\p{L}\p{N}\-./])(?:\d{3}-\d{2}-\d{4}|[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z] ?\d{2} ?\d{2} ?\d{2} ?[A-D])(?![\p{L}\p{N}\-/]|\.\d)")
#: The first cell under a column of person ids, and a cell beside a phone number in a table row.
ID_COLUMN = regex.compile(rf"(?<![\w])(?:anon_?id|patient_?id|subject_?id|participant_?id|pid|mrn)(?:,\w+)+['\"`]?[^`'\"\n]{{0,24}}['\"`\n] ?({ID_SHAPE.pattern})(?=,)", regex.I)
ID_CELL = regex.compile(rf"\| *[+(\d][\d ()+./‐-―-]{{7,20}} *\| *({ID_SHAPE.pattern}) *(?:\||$)", regex.I | regex.M)
NO_PERSON = regex.compile(r"(?:pmid|pmc|doi|isbn|issn|ticket|issue|bug|seed|accession|build|version|arxiv|order|invoice|sequence|rows?|positions?|line)[\s:#=(]{0,3}$", regex.I)

SEP = r"[  .\-/‐-―‑]"
PHONE = regex.compile(
    rf"(?<![\p{{L}}\p{{N}}+_./\-])(?:(?:\+|00)[1-9]\d{{0,2}}(?:{SEP}{{0,3}}\(?\d{{1,5}}\)?){{2,6}}|(?:1{SEP}?)?\([2-9]\d{{2}}\){SEP}{{0,2}}\d{{3}}{SEP}?\d{{4}}|(?:1{SEP})?[2-9]\d{{2}}{SEP}\d{{3}}{SEP}\d{{4}}|"
    rf"\(0\d{{1,5}}\){SEP}{{0,3}}\d{{2,8}}(?:{SEP}\d{{2,6}}){{0,3}}|0\d{{1,5}}{SEP}{{1,3}}\d{{2,8}}(?:{SEP}{{1,3}}\d{{2,6}}){{0,4}})(?![\p{{L}}\p{{N}}_]|{SEP}?\d|\.\d)"
)
PHONE_LABEL = regex.compile(r"(?:phone|tel(?:efono|éfono|efon|ephone)?|mobile|mobil|cell|fax|sms|call|text|contact|whatsapp|handy|ring|--to|llama al|sinon|notify_tel|dial)\b[\s.:='\"/)#-]*(?:me |us |at |on |to |al |au |unter )?['\"]?$", regex.I)
PHONE_BARE = regex.compile(r"(?<![\p{L}\p{N}+_./\-])(?:1?[2-9]\d{2}[2-9]\d{6}|0\d{9,11})(?![\p{L}\p{N}_/]|[.\-]\d)")

NUMBER = r"\d{1,5} ?(?:[A-Za-z]\b|(?:bis|ter|quater)\b)?"
WORD = r"[\p{L}][\p{L}'’\-]*(?:(?<=\b(?:st|ste|mt|ft|dr))\.)?"
OF = r"(?: (?:de la|de los|de las|des|de|du|del|della|dos|da|la|le|les|los|las|el)| (?:de )?l['’](?=\p{L})| d['’](?=\p{L}))*"
FRENCH = rf"{OF}(?:(?<=['’])| ){WORD}"
UNIT = rf"(?:,? (?:#\s?\d{{1,5}}[A-Za-z]?|(?:{UNITS})\.? ?#?\d{{1,5}}[A-Za-z]?)\b)?"
ADDRESS = regex.compile(
    rf"(?<![\p{{L}}\p{{N}}.\-/#$])(?:(?:{BOXES})\.? ?#?\d{{1,6}}{UNIT}|"
    rf"\d{{1,5}}(?: ?[A-Za-z](?=[ ,])| ?(?:bis|ter|quater)\b)?,? (?:{STREET_FIRST}){FRENCH}{UNIT}|"
    rf"(?:{STREET_FIRST})(?: {WORD}){{1,4}}?,? \d{{1,5}} ?[A-Za-z]?\b{UNIT}|"
    rf"[\p{{L}}][\p{{L}}\-]+(?:{STREET_JOINED}) \d{{1,5}} ?[A-Za-z]?\b{UNIT}|"
    rf"\d{{1,5}}(?:[A-Za-z]| [A-Za-z](?= ))?,? (?:(?:N|S|E|W|NE|NW|SE|SW|North|South|East|West)\.? )?(?:{WORD} ){{0,3}}?{WORD} (?:{STREET_WORDS})\b\.?{UNIT})(?![\p{{L}}\p{{N}}])",
    regex.I,
)

STREET_BEFORE = regex.compile(rf"^\d{{1,5}}\S*(?: (?:bis|ter|quater))?,? (?:{STREET_FIRST}) ", regex.I)

CAP = r"\p{Lu}[\p{L}]*(?:['’](?![sS]\b)\p{L}+)*(?:-\p{L}+(?:['’](?![sS]\b)\p{L}+)*)*"
ANY = r"\p{L}+(?:['’](?![sS]\b)\p{L}+)*(?:-\p{L}+(?:['’](?![sS]\b)\p{L}+)*)*"
TOKEN = regex.compile(rf"{ANY}")
CUE_BEFORE = regex.compile(rf"(?:(?<![\p{{L}}\p{{N}}])(?:{'|'.join(sorted((re.escape(c) for c in set(LEFT_CUES)), key=len, reverse=True))})|(?<![\p{{L}}])(?:{'|'.join(TITLES)})\.?|\(c\) \d{{4}}|©(?: \d{{4}})?)[\s'\"]{{1,3}}$", regex.I)
#: What the last word before a cued name must be, so that CUE_BEFORE is tried on few words.
LAST_WORD = re.compile(r"([^\W\d_]+)[.,:]*$")
CUE_ENDS = frozenset(LAST_WORD.search(c.lower()).group(1) for c in (*LEFT_CUES, *TITLES))
CAPITAL = regex.compile(rf"(?<=[\s'\"]){CAP}")
AFTER_CUED = regex.compile(rf"(?: \p{{Lu}}\.)?(?: (?:{'|'.join(PARTICLES)}))? \p{{Lu}}|[,:]|\s?\n", regex.I)
NEXT_PART = regex.compile(rf" (?:(\p{{Lu}}\.)(?= )|((?:(?:{'|'.join(PARTICLES)}) ){{0,2}})({ANY}))", regex.I)
LAST_INITIAL = regex.compile(r" \p{Lu}\.$")
INVERTED, SECOND = regex.compile(rf", ({ANY})"), regex.compile(rf" (?:({ANY})|\p{{Lu}}\.)")
INITIALS = regex.compile(rf"\.(?: \p{{Lu}}\.)* ((?:(?:{'|'.join(PARTICLES)}) ){{0,2}})({CAP})")
PARTICLES_BEFORE = regex.compile(rf"(?<![\p{{L}}\p{{N}}])(?:(?:(?:{'|'.join(PARTICLES)}) ){{1,2}})$")
TITLE_BEFORE = regex.compile(rf"(?<![\p{{L}}])(?:{'|'.join(TITLES)})\.? $")


# The words at which a full pattern is tried at all, as sets and beginnings of words.
STREET_SET = frozenset(re.sub(r"\\.\?", "", f"{STREET_WORDS}|{STREET_FIRST}").split("|")) | {"box", "pobox", "postbox", "postfach", "apartado", "boîte", "case", "casilla", "bag", "bp", "p"}
JOINED_ENDS = tuple(STREET_JOINED.replace("\\.?", "").split("|"))
ID_WORDS = (
    "passport", "reisepass", "pasaporte", "passeport", "ssn", "social", "sozialversicherungsnummer", "national", "nino", "health", "care", "phn", "mrn", "medical", "nhs", "medicare", "chart", "hospital", "patient",
    "participant", "subject", "id", "personnummer", "personalausweis", "steuer", "versicherungsnummer", "versichertennummer", "insurance", "carte", "numéro", "dni", "nie", "curp", "cpf", "sin", "driver", "licence", "tax", "itin", "member",
)
AT_WORDS = frozenset(("at", "a", "arroba"))
AT_ANCHOR = regex.compile(rf"{AT}(?=({LABEL_}(?:{DOT}{LABEL_})*?{DOT}(?:\p{{Ll}}{{2,24}}|\p{{Lu}}{{2,24}})))")
#: Stretches that hold all digits of a phone number, and shapes without which no pattern of a number can match.
DIGITS = re.compile(rf"(?:00|[+(]|\d)[\d()+{SEP[1:-1]}]{{6,}}")
BARE_DIGITS, ALONE = re.compile(r"\d{10}"), re.compile(r"\d{3}-\d{2}-\d{4}|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]")
#: Flags of a word: what may begin or stand at it.
KNOWN, CANDIDATE, STREET, ID_START, AT_WORD = 1, 2, 4, 8, 16
PARTS = re.compile(r"[^\-'’]+")


def _stretches(text: str, anchors: list[tuple[int, int]], blank: str, before: int, after: int) -> Iterator[tuple[int, int]]:
    """(start, end) of `before` words before each anchor to `after` words behind it, of any length; those that meet are one.

    blank: the only character between words of a match.
    """
    a = b = -1
    for start, end in anchors:
        floor, lo = max(a, text.rfind("\n", 0, start) + 1) if blank == " " else max(a, 0), start
        for _ in range(before):
            lo = text.rfind(blank, floor, lo)
            if lo < 0:
                lo = floor
                break
        hi = end
        for _ in range(after):
            hi = text.find(blank, hi + 1)
            if hi < 0:
                hi = len(text)
                break
        if b < 0 or lo > b:
            if b >= 0:
                yield a, b
            a = lo
        b = max(b, hi)
    if b >= 0:
        yield a, b


def _matches(pattern: regex.Pattern, text: str, a: int, b: int) -> Iterator[regex.Match]:
    """Matches of pattern that begin in text[a:b]: what the end of the stretch cuts or lets through is tried on the whole text."""
    while m := pattern.search(text, a, b):
        if m.end() < b - 8 or b == len(text):
            yield m
            a = m.end()
        elif whole := pattern.match(text, m.start()):
            yield whole
            a = whole.end()
        else:
            a = m.start() + 1


def _blank(text: str, spans: list[tuple[int, int]]) -> str:
    """text with the spans overwritten, so that later rules pass over them and positions stay."""
    if not spans:
        return text
    out, at = [], 0
    for a, b in sorted(spans):
        out += [text[at:a], "\x01" * (b - max(a, at))]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _digits(s: str) -> int:
    return sum(c.isdigit() for c in s)


def find_emails(text: str, words: list[tuple[int, int, str, int]]) -> list[tuple[int, int]]:
    """Plain addresses are found before the text is cut into words; these are the disguised ones, around what stands for '@'."""
    at = []
    for a in sorted([a for a, _, _, f in words if f & AT_WORD] + [m.start() for m in re.finditer("@", text)]):
        if m := next((m for i in range(3, -1, -1) if a >= i and (m := AT_ANCHOR.match(text, a - i))), None):
            at.append((m.start(), m.end(1)))
    out: list[tuple[int, int]] = []
    for start, end in at:
        # LOCAL (DOT LOCAL)? before it: six stretches without blanks at most, whatever blanks stand between them
        lo = start
        for _ in range(6):
            lo = len(text[:lo].rstrip())
            while lo and not text[lo - 1].isspace():
                lo -= 1
        out += [m.span() for m in _matches(DISGUISED, text, max(lo, out[-1][1] if out else 0), end) if not out or m.start() >= out[-1][1]]
    return out


def find_ids(text: str, words: list[tuple[int, int, str, int]]) -> list[tuple[int, int]]:
    """Shapes right behind a label, or, where none follows it, the last shape shortly before it on its line."""
    spans = [m.span() for m in ID_ALONE.finditer(text) if not NO_PERSON.search(text[max(0, m.start() - 16) : m.start()])] if ALONE.search(text) else []
    spans += [m.span(1) for p in (ID_COLUMN, ID_CELL) for m in p.finditer(text)]
    done = 0
    for start in (a + m.start() for a, _, word, f in words if f & ID_START for m in PARTS.finditer(word)):
        label = ID_LABEL.match(text, start) if start >= done else None
        if not label:
            continue
        done = label.end()
        after = ID_SHAPE.match(text, label.end() + len(m.group()) if (m := re.match(r"[\s'\"`]{0,2}", text[label.end() : label.end() + 2])) else label.end())
        if after and _digits(after.group()) >= 3:
            spans.append(after.span())
            continue
        begin = max(0, label.start() - 70, text.rfind("\n", 0, label.start()) + 1, text.rfind(". ", 0, label.start()) + 1)
        before = [m for m in ID_SHAPE.finditer(text, begin, label.start()) if _digits(m.group()) >= 4 and not NO_PERSON.search(text[max(0, m.start() - 16) : m.start()])]
        if before and re.search(r"[(\"'`:]\s*$|\bthe $", text[: label.start()][-3:] + "") or before and text[label.start() - 4 : label.start()] == "the ":
            spans.append(before[-1].span())
    return sorted(set(spans))


def find_phones(text: str) -> list[tuple[int, int]]:
    spans = []
    for m in (m for s in DIGITS.finditer(text) for m in PHONE.finditer(text, s.start(), s.end() + 3)):
        n, left = _digits(m.group()), text[max(0, m.start() - 24) : m.start()]
        if not 8 <= n <= 15 or NO_PERSON.search(left) or re.fullmatch(r"\d{4}-\d{2}-\d{2}|0?\d{1,2}[./-]\d{1,2}[./-]\d{4}", m.group()):
            continue
        spans.append(m.span())
    rest = _blank(text, spans)
    for m in PHONE_BARE.finditer(rest) if BARE_DIGITS.search(rest) else ():
        left = text[max(0, m.start() - 24) : m.start()]
        if PHONE_LABEL.search(left) or m.group()[0] != "0" and not NO_PERSON.search(left):
            spans.append(m.span())
    return spans


def find_addresses(text: str, common: set[str], words: list[tuple[int, int, str, int]]) -> list[tuple[int, int]]:
    """A street named first ('rue de X') goes on over further capitalised words that are not common ones."""
    spans = []
    anchors = [(a, b) for a, b, _, f in words if f & STREET]
    for m in (m for s in _stretches(text, anchors, " ", 9, 14) for m in _matches(ADDRESS, text, *s)):
        a, b = m.span()
        while re.match(r"\d", m.group()) and STREET_BEFORE.search(m.group()) and (more := re.compile(r" ([A-ZÀ-Þ][\w'’-]+)").match(text, b)) and more.group(1).lower() not in common:
            b = more.end()
        while text[b - 1] in " .,":
            b -= 1
        spans.append((a, b))
    return spans


class _Changed:
    """A large set with a few words more and a few less, without a copy of it."""

    def __init__(self, words: set[str], more: set[str], less: set[str]):
        self.words, self.more, self.less = words, more, less

    def __contains__(self, word: str) -> bool:
        return word in self.more or word in self.words and word not in self.less


class Names:
    """Names of persons by two word lists: given names (known ones and those learned from cues) and common words.

    rest: a table (word) of the given names that are not in the set, None if there are none.
    """

    def __init__(self, given: set[str], common: set[str], rest: DataFrame | None = None):
        self.given, self.common, self.rest = given, common - given, rest
        self.flags: dict[str, int] = {}

    def plus(self, more: list[str] | None) -> Names:
        """These names and more given names: those of rest that stand in one text."""
        if not more:
            return self
        own = Names(set(), set())
        own.given, own.common = _Changed(self.given, set(more), set()), _Changed(self.common, set(), set(more))
        return own

    def _surname(self, s: str, lower: bool) -> bool:
        parts = s.lower().split("-")
        return len(s) > 2 and (lower or s[0].isupper()) and not all(p in self.common for p in parts)

    def _extend(self, text: str, at: int, lower: bool) -> int:
        """The end of the name whose first token ends at `at`: further given names, initials, particles and a surname."""
        end, surname = at, False
        while not surname:
            m = NEXT_PART.match(text, end)
            if not m:
                break
            if m.group(1):
                end = m.end()
                continue
            word = m.group(3)
            if word.lower() in self.given and not m.group(2) and (word[0].isupper() or lower):
                end = m.end()
                continue
            if not self._surname(word, lower):
                break
            end, surname = m.end(), True
        while end > at and LAST_INITIAL.search(text, max(at, end - 3), end):
            end -= 3
        return end

    def _flag(self, word: str) -> int:
        low = word.lower()
        known = low in self.given
        f = KNOWN | CANDIDATE if known else CANDIDATE if word[0].isupper() and (len(word) == 1 or low not in self.common) else 0
        for part in PARTS.findall(low):
            f |= STREET * (part in STREET_SET or part.endswith(JOINED_ENDS)) | ID_START * part.startswith(ID_WORDS) | AT_WORD * (part in AT_WORDS)
        return f

    def words(self, text: str) -> list[tuple[int, int, str, int]]:
        """(start, end, word, flags) of the words at which a pattern may match; most words leave by one look-up."""
        out, flags = [], self.flags
        if len(flags) > COUNTER_WORDS:
            flags.clear()
        for m in TOKEN.finditer(text):
            word = m.group()
            f = flags.get(word)
            if f is None:
                f = flags[word] = self._flag(word)
            if f:
                out.append((m.start(), m.end(), word, f))
        return out

    def _candidates(self, text: str, words: list[tuple[int, int, str, int]]) -> Iterator[tuple[int, int, str, bool]]:
        """(start, end, word, known) of the words that can begin a name: given names, rare capitalised words, initials."""
        for a, b, word, f in words:
            if f & CANDIDATE:
                before, after = text[a - 1 : a], text[b : b + 2]
                if a and (before.isalnum() or before in "_@/\\.$+-\x01") and not (before == "." and a > 1 and text[a - 2].isspace()):
                    continue
                if after and (after[0].isnumeric() or after[0] in "_@/\\=[" or after[0] == "." and after[1:].isalpha()):
                    continue
                yield a, b, word, bool(f & KNOWN)

    def find(self, text: str, words: list[tuple[int, int, str, int]]) -> list[tuple[int, int]]:
        spans, done = [], 0
        for a, b, word, known in self._candidates(text, words):
            if a < done:
                continue
            upper = word[0].isupper()
            cue = bool(CUE_BEFORE.search(text, max(0, a - 24), a))
            if known:
                end = self._extend(text, b, not upper)
                if not upper and not cue and end == b:
                    continue
            elif len(word) > 1 and self._surname(word, False):
                inverted = INVERTED.match(text, b)
                if inverted and inverted.group(1).lower() in self.given and inverted.group(1)[0].isupper():
                    end = inverted.end()
                    more = SECOND.match(text, end)
                    if more and more.group(1) and more.group(1).lower() in self.given:
                        end = more.end()
                elif cue and b - a > 2:
                    end = self._extend(text, b, False)
                    if end == b and not TITLE_BEFORE.search(text, max(0, a - 12), a):
                        continue
                else:
                    continue
            elif len(word) == 1 and text[b : b + 2] == ". ":
                more = INITIALS.match(text, b)
                if not more or not self._surname(more.group(2), False) or len(more.group(2)) < 4:
                    continue
                end = more.end()
            else:
                continue
            head = None if known else PARTICLES_BEFORE.search(text, max(0, a - 12), a)
            spans.append((a - len(head.group()) if head else a, end))
            done = end
        return spans


def find_all(text: str, names: Names) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every mention, without overlaps, in the order of the text."""
    out: list[tuple[str, int, int]] = []
    rest = text

    def take(kind: str | None, spans: list[tuple[int, int]]) -> None:
        nonlocal rest, words
        if kind:
            out.extend((kind, a, b) for a, b in spans)
        if spans:
            rest = _blank(rest, spans)
            apart = [w for w in words if all(w[1] <= a or w[0] >= b for a, b in spans)]
            whole = all(any(a <= w[0] and w[1] <= b for a, b in spans) for w in words if w not in apart) if len(spans) * len(words) < 10_000 else False
            words = apart if whole else names.words(rest)

    plain = [m.span() for m in EMAIL.finditer(text)] if "@" in text else []
    out.extend(("email", a, b) for a, b in plain)
    rest = _blank(text, plain)
    words = names.words(rest)
    take("email", find_emails(rest, words))
    if "://" in rest or "www." in rest:
        take(None, [m.span() for m in URL.finditer(rest)])
    take("id_number", find_ids(rest, words))
    take("phone", find_phones(rest))
    take("street_address", find_addresses(rest, names.common, words))
    take("person_name", names.find(rest, words))
    return sorted(out, key=lambda x: x[1])


def cued_words(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the capitalised words behind a cue that a further word, a comma, a colon or the line's end follows."""
    for m in CAPITAL.finditer(text):
        a, b = m.span()
        left = text[max(0, a - 24) : a].rstrip(" \t\n\r'\"")
        last = LAST_WORD.search(left)
        if (last and last.group(1).lower() in CUE_ENDS or left[-1:] == "©" or left[-1:].isdigit()) and AFTER_CUED.match(text, b) and CUE_BEFORE.search(text, max(0, a - 24), a):
            yield a, b


def count_words(df: DataFrame, text: str) -> DataFrame:
    """(word, prev, n, n_small, n_cue) over all texts, e-mail addresses and URLs aside: lower-case words.

    prev null: how often the word stands, how often without a capital, how often behind a cue. Else n capitalised uses right
    behind the capitalised word prev, initials and particles between them aside.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, small, cued = Counter(), Counter(), Counter()  # by (word, prev)
        spelled: Counter = Counter()

        def out() -> pa.RecordBatch:
            for w, n in spelled.items():
                total[w.lower(), None] += n
                if not w[0].isupper():
                    small[w.lower(), None] += n
            spelled.clear()
            clean = lambda w: w and w.encode("utf-8", "replace").decode()
            words = [pa.array([clean(k[i]) for k in total], pa.string()) for i in (0, 1)]
            batch = pa.RecordBatch.from_arrays([*words, *[pa.array([c[k] for k in total], pa.int64()) for c in (total, small, cued)]], ["word", "prev", "n", "n_small", "n_cue"])
            total.clear(), small.clear(), cued.clear()
            return batch

        pair = regex.compile(rf"(?<!\p{{L}})({CAP})(?: \p{{Lu}}\.)*(?: (?:{'|'.join(PARTICLES)})){{0,2}} (?=({CAP}))")
        for b in batches:
            for t in b.column(0).to_pylist():
                t = EMAIL.sub(" ", t) if "@" in t else t
                t = URL.sub(" ", t) if "://" in t or "www." in t else t
                spelled.update(TOKEN.findall(t))
                cued.update((t[a:b].lower(), None) for a, b in cued_words(t))
                total.update((m.group(2).lower(), m.group(1).lower()) for m in pair.finditer(t))
                if len(spelled) + len(total) > COUNTER_WORDS:
                    yield out()
        if spelled:
            yield out()

    counts = df.where(F.col(text).isNotNull()).select(text).mapInArrow(count, "word string, prev string, n bigint, n_small bigint, n_cue bigint")
    return counts.groupBy("word", "prev").agg(*[F.sum(c).alias(c) for c in ("n", "n_small", "n_cue")])


def _lower_words(df: DataFrame) -> DataFrame:
    """(word): the words of the only column in lower case, as Python makes it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([w and w.lower() for w in b.column(0).to_pylist()], pa.string())], ["word"])

    return df.mapInArrow(run, "word string").where("word <> ''")


def word_lists(df: DataFrame, text: str, given: list[str] | DataFrame) -> Names:
    """Names() from the counts over all texts and the known given names (a list, or a table of one column).

    At most LIST_WORDS given names, those that stand most often behind a cue, and 1 / COMMON_SHARE common words reach the
    driver; further given names stay a table, which is joined with the words of the texts.

    A word is common by its use without a capital; one that is mostly capitalised (at the head of sentences, German nouns)
    by all its use, unless it is a surname: behind a given name or a cue in NAME_SHARE of its use.
    """
    from ..session import materialise

    counts = materialise(count_words(df, text), "word-counts")
    single, pairs = counts.where("prev is null").drop("prev"), counts.where("prev is not null").select("word", "prev", F.col("n").alias("k"))
    words = single.agg(F.sum("n")).first()[0] or 0
    learned = single.where((F.col("n_cue") >= NAME_COUNT) & (F.col("n_cue") >= NAME_SHARE * F.col("n")) & (F.length("word") > 2))
    known = given if isinstance(given, DataFrame) else df.sparkSession.createDataFrame([(g,) for g in given], "word string")
    names = learned.select("word", "n_cue").unionByName(_lower_words(known).withColumn("n_cue", F.lit(0).cast("bigint")))
    names = materialise(names.groupBy("word").agg(F.max("n_cue").alias("n_cue")), "given-names")
    frequent = single.where(F.col("n") >= max(2.0, COMMON_SHARE * words))
    named = pairs.join(names.select(F.col("word").alias("prev")), "prev", "left_semi").groupBy("word").agg(F.sum("k").alias("k"))
    surname = F.coalesce("k", F.lit(0)) + F.col("n_cue") >= NAME_SHARE * F.col("n")
    common = frequent.join(named, "word", "left").where((F.col("n_small") >= max(2.0, COMMON_SHARE * words)) | ~surname)
    common = common.select("word").limit(int(1 / COMMON_SHARE)).collect()
    order = [F.desc("n_cue"), F.col("word")]
    listed = names.orderBy(*order).limit(LIST_WORDS + 1).collect()
    if len(listed) <= LIST_WORDS:
        return Names({r.word for r in listed}, {r.word for r in common})
    last, listed = listed[-2], listed[:-1]
    rest = names.where((F.col("n_cue") < last.n_cue) | (F.col("n_cue") == last.n_cue) & (F.col("word") > last.word)).select("word")
    return Names({r.word for r in listed}, {r.word for r in common}, rest)


# Character classes that a surrogate keeps, as lower-case letters; capitals move with them. Letters that are
# not listed have classes of their own: see _table.
CLASSES = (
    "0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "áàâäãåāăąæéèêëēėęěíìîïīįóòôöõøōőœúùûüūůűųýÿ", "çćčďđðğģķłľĺļñńňņŕřŗśšşșťţțþżźž",
    "аеёиоуыэюяіїє", "бвгґджзйклмнпрстфхцчшщўњљђћџј", "ъь", "αεηιουω", "άέήίόύώϊϋ", "βγδζθκλμνξπρστφχψ",
)


def _lower(c: str) -> str:
    """The small letter of c where the two belong to each other alone, else c (ß, ς, İ and letters without case)."""
    low = c.lower()
    return low if len(low) == 1 and low.upper() == c and low.lower() == low else c


@lru_cache(None)
def _table() -> dict[str, str]:
    """Letter or digit -> its class, for all of Unicode: CLASSES, else the same script, kind of letter and 256 code points.

    Classes of one member are put together, so that every letter and digit can move.
    """
    table = {c: k for k in CLASSES for c in k}
    rest: dict[tuple, list[str]] = {}
    for c in map(chr, range(0x110000)):
        if (c.isalpha() or c.isdecimal()) and c not in table and _lower(c) == c:
            paired = c.upper() != c and _lower(c.upper()) == c
            kind = (unicodedata.category(c), paired)
            rest.setdefault((*kind, unicodedata.name(c, "").split(" ")[0], unicodedata.decimal(c, None) is None and ord(c) >> 8), []).append(c)
    alone: dict[tuple, list[str]] = {}
    for kind, members in rest.items():
        (alone.setdefault(kind[:2], []) if len(members) == 1 else rest[kind]).extend(members if len(members) == 1 else [])
    for members in [m for m in rest.values() if len(m) > 1] + list(alone.values()):
        table |= dict.fromkeys(members, "".join(members))
    return table


@lru_cache(65_536)
def _place(c: str) -> tuple[str, int, bool] | None:
    """The class of c, its index there and whether c is the capital of that letter; None for what is no letter or digit."""
    low = _lower(c)
    own = next((k for k in CLASSES if low in k), None) or (None if c.isascii() else _table().get(low))
    return own and (own, own.index(low), low != c)


NAME_PART, DISGUISE = regex.compile(r"[\p{L}\p{M}'’]+"), regex.compile(rf"(?P<at>{AT})|{DOT}")
TRUNK = regex.compile(rf"^(?:\+|00)\d{{1,3}}{SEP}*\((0)\)")


def _entities(kind: str, mention: str) -> list[list[tuple[int, str]]]:
    """What a mention names, apart from how it is written: lists of (position, character); position -1 is written otherwise.

    Names go part by part, e-mail addresses undisguised, all else by letters and digits without what separates them.
    """
    if kind == "person_name":
        return [[(i, mention[i]) for i in range(*m.span()) if _place(mention[i])] for m in NAME_PART.finditer(mention)]
    if kind == "email":
        out, at = [], 0
        for m in [*DISGUISE.finditer(mention), None]:
            out += [(i, mention[i]) for i in range(at, m.start() if m else len(mention))]
            if m:
                out.append((-1, "@" if m["at"] else "."))
                at = m.end()
        return [out]
    trunk = m.start(1) if kind == "phone" and (m := TRUNK.match(mention)) else -1
    return [[(i, c) for i, c in enumerate(mention) if i != trunk and _place(c)]]


def _classes(kind: str, mention: str, entity: list[tuple[int, str]]) -> list[tuple[str, int, bool] | None]:
    """The place of each character of an entity, None for those that stay. Phone numbers keep 0 and 00 in front."""
    places = [_place(c) if i >= 0 else None for i, c in entity]
    if kind == "phone":
        head = len("".join(c for _, c in entity)) - len("".join(c for _, c in entity).lstrip("0"))
        head = min(head, 2) if not mention.startswith("+") else 0
        for k, (i, c) in enumerate(entity):
            if k < head or k == head and c == "0":
                places[k] = None
            elif c in "123456789" and (k == head or mention[i - 1 : i] == "(" and mention[i + 1 : i + 2] == ")"):
                places[k] = ("123456789", int(c) - 1, False)
    return places


def surrogate(kind: str, mention: str, key: bytes) -> str:
    """A keyed replacement of the same format, different from the mention and for different mentions of one kind and format.

    The entity (each part of a name, the undisguised e-mail address, else letters and digits alone) gets its letters and
    digits, of any script, moved within their classes by a keyed hash of the entity's shape and of all that stands before,
    the first one by at least one place: the mapping can be undone with the key, has no collisions, leaves no mention as it
    was, and gives an entity the same letters and digits in whatever format it is written. Case, separators, disguise, the
    0, 00 or + in front of a phone number and its (0) are the format and stay; so does the last letter of a part of a name
    where another one moves, and marks.
    """
    out = list(mention)
    for entity in _entities(kind, mention):
        places = _classes(kind, mention, entity)
        moving = [k for k, p in enumerate(places) if p]
        first = moving[0] if moving else -1
        if kind == "person_name" and len(moving) > 1:
            moving.pop()
        shape = "".join(c if p is None else p[0][0] for (_, c), p in zip(entity, places)).lstrip("0" if kind == "phone" else "")
        state, at = hashlib.blake2b(f"{kind}\0{shape}".encode("utf-8", "replace"), key=key, digest_size=16).digest(), set(moving)
        for k, (i, c) in enumerate(entity):
            if k in at:
                own, index, capital = places[k]
                shift = int.from_bytes(state[:4])
                new = own[(index + (1 + shift % (len(own) - 1) if k == first else shift)) % len(own)]
                out[i] = new.upper() if capital else new
            if k >= first:
                state = hashlib.blake2b(state + _lower(c).encode("utf-8", "replace"), key=key, digest_size=16).digest()
    return "".join(out)


def _with_rest(df: DataFrame, id_col: str, text: str, names: Names) -> DataFrame:
    """(id, text, more): more has the given names of names.rest among the words of the text."""
    kind, given = df.schema[id_col].dataType.simpleString(), df.sparkSession.sparkContext.broadcast(names.given)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, t in enumerate(b.column(1).to_pylist()):
                own = sorted({w.lower().encode("utf-8", "replace").decode() for w in TOKEN.findall(t or "")} - given.value)
                if own:
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([k] * len(own))), pa.array(own, pa.string())], ["_id", "word"])

    found = df.select(id_col, text).mapInArrow(words, f"_id {kind}, word string").join(names.rest, "word", "left_semi").groupBy("_id").agg(F.collect_set("word").alias("more"))
    return df.join(found, F.col(id_col).eqNullSafe(F.col("_id")), "left").select(id_col, text, "more")


def _run(df: DataFrame, id_col: str, text: str, names: Names, schema: str, per_text) -> DataFrame:
    lists = df.sparkSession.sparkContext.broadcast((names.given, names.common))  # bounded by LIST_WORDS and COMMON_SHARE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Names(*lists.value)
        for b in batches:
            more = b.column(2).to_pylist() if b.num_columns > 2 else [None] * b.num_rows
            rows = [r for i, t, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), more) for r in per_text(i, t, own.plus(m))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [b.schema.field(0).type, *[pa.string()] * (len(rows[0]) - 1)])], [c.split()[0].strip("`") for c in schema.split(",")])

    df = df.select(id_col, text)
    return (df if names.rest is None else _with_rest(df, id_col, text, names)).mapInArrow(run, schema)


def mentions(df: DataFrame, id_col: str, text: str, names: Names) -> DataFrame:
    """(id, kind, mention): each different mention of a text, exactly as it stands there. Null and empty texts have none."""
    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, kind string, mention string"
    return _run(df, id_col, text, names, schema, lambda i, t, own: [(i, *m) for m in dict.fromkeys((k, t[a:b]) for k, a, b in find_all(t, own))] if t else [])


# Cues of gender, and what made-up names are drawn from by script: beginnings of syllables, vowels, and the
# endings of names of women, men and others.
WOMEN = ("Mrs", "Ms", "Miss", "Frau", "Mme", "Mlle", "Sra", "Dra", "Doña", "Madame", "Señora", "sister", "wife", "mother", "landlady", "daughter")
MEN = ("Mr", "Herr", "M", "Sr", "Don", "Sir", "Monsieur", "Señor", "brother", "husband", "father", "landlord", "son")
SYLLABLES = {
    "LATIN": ("b c d f g h j k l m n p r s t v w z br dr gr kl st tr".split(), "a e i o u".split(), {"f": "a ia ina ella".split(), "m": "o us an er".split(), "": "e in el ot ak is".split()}),
    "CYRILLIC": ("б в г д ж з к л м н п р с т ф х ч бр др ст".split(), "а е и о у".split(), {"f": "а ия ина".split(), "m": "ан ор ий".split(), "": "е ко ен ук".split()}),
    "GREEK": ("β γ δ ζ θ κ λ μ ν ξ π ρ σ τ φ χ στ τρ".split(), "α ε η ι ο υ".split(), {"f": "α ια η".split(), "m": "ος ης ας".split(), "": "ου ι ω".split()}),
}
#: How the ending of a name without cue is read.
ENDINGS = (("f", ("a", "elle", "ine", "ette", "а", "я", "α", "η", "ά", "ή")), ("m", ("o", "us", "ος", "ης", "ας", "ий")))
DRAWN_LETTERS = 3
ROUNDS = 64
WOMAN_BEFORE, MAN_BEFORE = (regex.compile(rf"(?<!\p{{L}})(?:{'|'.join(w)})\.? $", regex.I) for w in (WOMEN, MEN))


def _script(part: str) -> str:
    return unicodedata.name(part[0], "").split(" ")[0]


def is_drawn(part: str) -> bool:
    """Whether a part of a name gets a made-up name; shorter ones, other scripts and particles move within their classes."""
    return len(part) >= DRAWN_LETTERS and part not in PARTICLES and _script(part) in SYLLABLES


def gender_of(part: str, women: int, men: int) -> str:
    """'f', 'm' or '': what most cues of the corpus say, else the ending."""
    if women != men:
        return "f" if women > men else "m"
    return next((g for g, ends in ENDINGS if part.endswith(ends)), "")


def drawn_name(part: str, gender: str, attempt: int, key: bytes) -> str:
    """A made-up name of the same script and gender, about as long, drawn by a keyed hash; later attempts draw longer ones."""
    heads, vowels, ends = SYLLABLES[_script(part)]
    n = int.from_bytes(hashlib.blake2b(f"name\0{part}\0{gender}\0{attempt}".encode("utf-8", "replace"), key=key, digest_size=32).digest())
    out = ""
    for pool in [heads, vowels] * (1 + (len(part) > 4) + (len(part) > 7) + attempt // 4) + [heads, ends[gender]]:
        n, k = divmod(n, len(pool))
        out += pool[k]
    return out


def name_surrogate(mention: str, key: bytes, exceptions: dict[str, tuple[str, int]]) -> str:
    """A name with every part replaced: the same part by the same name, in whatever mention and case it stands.

    exceptions: part -> (gender, attempt) where these are not those of gender_of(part, 0, 0) and 0.
    """

    def one(m: regex.Match) -> str:
        word, part = m.group(), m.group().lower()
        if part in PARTICLES:
            own = sorted(p for p in PARTICLES)
            shift = 1 + int.from_bytes(hashlib.blake2b(b"particle", key=key, digest_size=4).digest()) % (len(own) - 1)
            new = own[(own.index(part) + shift) % len(own)]
        elif is_drawn(part):
            new = drawn_name(part, *exceptions.get(part, (gender_of(part, 0, 0), 0)), key)
        else:
            return surrogate("person_name", word, key)
        return new.upper() if word.isupper() and len(word) > 1 else new.capitalize() if word[0].isupper() else new

    return NAME_PART.sub(one, mention)


def _spans(df: DataFrame, id_col: str, text: str, names: Names) -> DataFrame:
    """(id, text, kinds, starts, ends, cues): all texts with their mentions, written once; cues: gender said before a name."""
    from ..session import materialise

    lists = df.sparkSession.sparkContext.broadcast((names.given, names.common))  # bounded by LIST_WORDS and COMMON_SHARE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Names(*lists.value)
        for b in batches:
            more = b.column(2).to_pylist() if b.num_columns > 2 else [None] * b.num_rows
            found = [find_all(t, own.plus(m)) if t else [] for t, m in zip(b.column(1).to_pylist(), more)]
            cues = [["" if k != "person_name" else "f" if WOMAN_BEFORE.search(t, max(0, a - 24), a) else "m" if MAN_BEFORE.search(t, max(0, a - 24), a) else "" for k, a, _ in f] for t, f in zip(b.column(1).to_pylist(), found)]
            arrays = [[[m[i] for m in f] for f in found] for i in range(3)]
            kinds = [pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(v, k) for v, k in zip([*arrays, cues], kinds)]], [id_col, text, "_kinds", "_starts", "_ends", "_cues"])

    rows = df.select(id_col, text)
    rows = rows if names.rest is None else _with_rest(rows, id_col, text, names)
    kind = df.schema[id_col].dataType.simpleString()
    return materialise(rows.mapInArrow(run, f"`{id_col}` {kind}, `{text}` string, _kinds array<string>, _starts array<int>, _ends array<int>, _cues array<string>"), "spans")


def _parts_of(b: pa.RecordBatch) -> Iterator[tuple[int, str, str]]:
    """(row, part, cue) of the drawn parts of the names of a batch of _spans; the cue goes with the first part."""
    for i, (t, kinds, starts, ends, cues) in enumerate(zip(*(b.column(c).to_pylist() for c in range(1, 6)))):
        for k, a, e, cue in zip(kinds, starts, ends, cues):
            if k == "person_name":
                for n, m in enumerate(NAME_PART.finditer(t, a, e)):
                    if is_drawn(part := m.group().lower()):
                        yield i, part, cue if n == 0 else ""


def exceptional_names(spans: DataFrame, given: set[str], key: bytes) -> DataFrame:
    """(part, gender, attempt) of the parts of names in all texts whose surrogate is not the first draw by their ending.

    The gender is what most cues before a given name say. Collision check: the drawn names of all different parts are
    joined with each other and with the parts themselves; of parts that share a name all but one, and parts whose name is
    a real part, are drawn again until none is left, so different parts have different names and none is somebody's own.
    """
    from ..session import discard, materialise

    known = spans.sparkSession.sparkContext.broadcast(given)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums: dict[str, list[int]] = {}
            for _, part, cue in _parts_of(b):
                own = sums.setdefault(part, [0, 0])
                if part in known.value:
                    own[0] += cue == "f"
                    own[1] += cue == "m"
            clean = [p.encode("utf-8", "replace").decode() for p in sums]
            yield pa.RecordBatch.from_arrays([pa.array(clean, pa.string()), *[pa.array([v[i] for v in sums.values()], pa.int64()) for i in (0, 1)]], ["part", "women", "men"])

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(zip(*(b.column(i).to_pylist() for i in range(4))))
            genders = [gender_of(p, w, m) for p, w, m, _ in rows]
            drawn = [drawn_name(p, g, n, key) for (p, _, _, n), g in zip(rows, genders)]
            odd = [g != gender_of(p, 0, 0) or n > 0 for (p, _, _, n), g in zip(rows, genders)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(genders, pa.string()), pa.array(drawn, pa.string()), pa.array(odd, pa.bool_())], ["part", "women", "men", "attempt", "gender", "name", "odd"])

    schema = "part string, women bigint, men bigint, attempt int, gender string, name string, odd boolean"
    base = spans.mapInArrow(count, "part string, women bigint, men bigint").groupBy("part").agg(F.sum("women").alias("women"), F.sum("men").alias("men"))
    now = materialise(base.select("part", "women", "men", F.lit(0).alias("attempt")).mapInArrow(draw, schema), "surrogates")
    for _ in range(ROUNDS):
        first = now.groupBy("name").agg(F.min(F.struct("attempt", "part")).alias("_keep"))
        real = now.select(F.col("part").alias("name"), F.lit(True).alias("_real"))
        marked = materialise(now.join(first, "name").join(real, "name", "left").withColumn("_again", (F.col("_keep.part") != F.col("part")) | F.col("_real").isNotNull()).drop("_keep", "_real"), "surrogates")
        discard(now)
        if marked.where("_again").isEmpty():
            return marked.where("odd").select("part", "gender", "attempt")
        again = marked.where("_again").select("part", "women", "men", (F.col("attempt") + 1).cast("int").alias("attempt")).mapInArrow(draw, schema)
        columns = ["part", "women", "men", "attempt", "gender", "name", "odd"]
        now = materialise(marked.where("not _again").select(*columns).unionByName(again.select(*columns)), "surrogates")
        discard(marked)
    raise ValueError("the surrogates still collide")


def redact(df: DataFrame, id_col: str, text: str, names: Names, key: bytes) -> DataFrame:
    """(id, text): every mention replaced by [KIND surrogate]; all else, null and empty texts included, as it was.

    Texts are searched once; the surrogates of names are checked for collisions over the whole corpus. The parts drawn
    otherwise than by default are broadcast up to LIST_WORDS of them, else joined with the parts of each text.
    """
    from ..session import bounded_rows

    spans = _spans(df, id_col, text, names)
    odd = exceptional_names(spans, names.given, key)
    rows = bounded_rows(odd, LIST_WORDS)
    shared = spans.sparkSession.sparkContext.broadcast({r.part: (r.gender, r.attempt) for r in rows or []})
    kind = df.schema[id_col].dataType.simpleString()
    if rows is None:

        def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                own = list(dict.fromkeys((i, p) for i, p, _ in _parts_of(b)))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([i for i, _ in own], pa.int64())), pa.array([p for _, p in own], pa.string())], ["_id", "part"])

        more = spans.mapInArrow(parts, f"_id {kind}, part string").join(odd, "part").groupBy("_id").agg(F.collect_set(F.struct("part", "gender", "attempt")).alias("_more"))
        spans = spans.join(more, F.col(id_col).eqNullSafe(F.col("_id")), "left").drop("_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = []
            columns = [b.column(c).to_pylist() for c in range(1, 5)]
            for t, kinds, starts, ends, more in zip(*columns, b.column(6).to_pylist() if b.num_columns > 6 else [None] * b.num_rows):
                odd_names = {m["part"]: (m["gender"], m["attempt"]) for m in more} if more else shared.value
                out, at = [], 0
                for k, a, e in zip(kinds, starts, ends):
                    new = name_surrogate(t[a:e], key, odd_names) if k == "person_name" else surrogate(k, t[a:e], key)
                    out += [t[at:a], f"[{k.upper()} {new}]"]
                    at = e
                done.append("".join([*out, t[at:]]) if out else t)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(done, pa.string())], [id_col, text])

    return spans.mapInArrow(run, f"`{id_col}` {kind}, `{text}` string")
