"""Personal information in free text: found on a normalised reading of it, reported at its place in the source.

Transducers rewrite a text while keeping, for every character written, the place of the one it came from:
look-alike letters and full-width forms, words for digits, and disguised at signs and dots. Identifiers are
found in what they write; their spans are mapped back.
"""

from __future__ import annotations

import base64
import re as stdre
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
import regex as re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.session import spread

SPAN = "array<struct<kind:string,start:int,end:int>>"
WORDS, CASED = "/opt/tokenizers/word_bpe_49k.json", ("/opt/tokenizers/byte_bpe_50k.tiktoken", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")

# Letters of other scripts that look like Latin ones.
LOOKALIKES = dict(zip("аеорсхуіјѕһԁԛԝкмтвнАВЕКМНОРСТХУІЈЅοαενρτυικΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcxyijshdqwkmtbhABEKMHOPCTXYIJSoaevptuikABEZHIKMNOPTYX"))
# Characters without width, hyphens and spaces.
INVISIBLE, HYPHENS, SPACES = "\u200b\u200c\u200d\u2060\ufeff\u00ad", "\u2010\u2011\u2012\u2013\u2212", "\u00a0\u2007\u2009\u202f"
HIDDEN = re.compile(f"[{INVISIBLE}]")
ONE_TO_ONE = str.maketrans({**LOOKALIKES, **dict.fromkeys(HYPHENS, "-"), **dict.fromkeys(SPACES, " "), **{chr(c): unicodedata.normalize("NFKC", chr(c)) for c in range(0xFF01, 0xFF5F) if chr(c) not in "，：；（）！？"}})
# Words for digits.
DIGITS = {w: str(n) for n, words in enumerate(("zero oh null zéro", "one eins un", "two zwei deux", "three drei trois", "four vier quatre", "five fünf cinq", "six sechs", "seven sieben sept", "eight acht huit", "nine neun neuf")) for w in words.split()}
_DIGIT = "|".join(sorted(DIGITS, key=len, reverse=True))
SPELLED = re.compile(rf"(?i)\b(?:{_DIGIT})(?:[ ,-]+(?:{_DIGIT})){{5,}}\b")
AT = re.compile(r"[ \t]?[\[({<][ \t]?at[ \t]?[\])}>][ \t]?|(?<=\w)[ \t]AT[ \t](?=\w)", re.I)
# Last parts of host names, by which an address in plain words is told from prose.
HOST_ENDS = "com|org|net|edu|gov|io|co|info|biz|de|fr|uk|ch|it|es|nl|eu|us|ca|cn|jp|example|invalid|test"
SAID = re.compile(rf"(?i)\b[\w+.-]+(?:[ \t]dot[ \t][\w+-]+)*+[ \t]at[ \t][\w-]+(?:(?:[ \t]dot[ \t]|\.)[\w-]+)*?(?:[ \t]dot[ \t]|\.)(?:{HOST_ENDS})\b")
SAID_PART = re.compile(r"(?i)[ \t](at|dot)[ \t]")
DOT = re.compile(r"[ \t]?[\[({<][ \t]?dot[ \t]?[\])}>][ \t]?|(?<=\w)[ \t]dot[ \t](?=\w)", re.I)

EMAIL = re.compile(r"(?<![A-Za-z0-9.+_%-])[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}")
_ID_CUE = r"(?i:ausweis(?:nummer)?|steuer-?(?:id|nummer)|id-?nr\.?|passport|pass(?:nummer)?|ssn(?:/ni)?|ni|id(?: on file)?|dossier|sécurité sociale|身份证号?|证件号码?|\"doc\")\W{0,4}"
IDS = [
    re.compile(r"(?<![\w.+-])\d{3}([- ])\d{2}\1\d{4}(?![\w-])"),
    re.compile(r"(?<!\w)[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D](?!\w)"),
    re.compile(r"(?<![\w-])[A-Z]{1,2}\d{7,8}(?![\w-])"),
    re.compile(r"(?<![\d.+-])[12] \d{2} \d{2} \d{2} \d{3} \d{3} \d{2}(?! ?\d)"),
    re.compile(r"(?<![\w.+-])\d{2} \d{3} \d{3} \d{3}(?!\w)"),
    re.compile(r"(?<![A-Za-z\d.+-])\d{17}[\dXx](?![A-Za-z\d])"),
    re.compile(rf"(?<={_ID_CUE})(?:\d{{15}}|\d{{11}}|\d{{9}})(?!\w)"),
]
PHONES = [
    re.compile(r"(?<![\w+])\+\d{1,3}(?:[ .-]?\(0\))?(?:[ .-]?\d{1,5}){2,5}(?!\d)"),
    re.compile(r"(?<![\w.+-])00[1-9]\d(?:[ .-]?\(0\))?(?:[ .-]\d{2,5}){2,4}(?!\d)"),
    re.compile(r"(?<![\w.+-])\([2-9]\d{2}\) ?\d{3}[-. ]\d{4}(?!\d)"),
    re.compile(r"(?<![\w.+-])[2-9]\d{2}([-. ])[2-9]\d{2}\1\d{4}(?![\d-])"),
    re.compile(r"(?<![\w.+-])[2-9]\d{2}[2-9]\d{6}(?!\w)"),
    re.compile(r"(?<![\w.+-])0[1-9](?:([ .-])\d{2})(?:\1\d{2}){3}(?!\w)"),
    re.compile(r"(?<![\w.+-])0\d{4} \d{6}(?!\w)"),
    re.compile(r"(?<![\w.+-])0[1-9]\d{1,3}[ /-]\d{4,6}(?:[ -]\d{1,4})?(?!\w)"),
    re.compile(r"(?<![A-Za-z\d.+-])1\d{2}[ -]\d{4}[ -]\d{4}(?!\d)"),
    re.compile(r"(?<=(?i:tel(?:efon)?|phone|handy|mobil(?:e)?|fax|call|ring|téléphone|tél|电话|手机)[^\w\n]{0,4})(?:0[1-9]\d{8,10}|1\d{10})(?!\w)"),
]
#: What stands before a number in prose, a count or a task, which is no telephone.
NOT_PHONE = frozenset("of time ticket task aufgabe tâche case cases build version id".split())
_STREET = r"(?:[Ll]ane|[Rr]oad|[Ss]treet|[Aa]venue|[Dd]rive|[Cc]ourt|[Cc]lose|[Tt]errace|[Ss]quare|[Bb]oulevard|[Ww]ay|[Pp]lace|[Cc]rescent|Row|Walk|Mews|Gardens|Grove|Rise|Parade|Circle|Trail|[Hh]ighway|[Pp]arkway|Alley|Quay|Wharf|Plaza|(?:St|Rd|Ave|Ln|Dr|Blvd|Cres|Ct|Pl|Sq|Ter|Hwy|Pkwy)\b\.?)"
ADDRESSES = [
    re.compile(rf"(?<![\w.,+-])\d{{1,4}}[A-Za-z]? (?:[^\W\d_][\w'’-]+ ){{1,2}}?{_STREET}(?!\w)"),
    # without a word for the street: a town and its postcode have to follow
    re.compile(r"(?<![\w.,+-])\d{1,4}[A-Za-z]? \p{Lu}[\w'’-]+(?: \p{Lu}[\w'’-]+)?(?=,[ \t]*\p{Lu}[\p{Ll}]+(?:[ -]\p{Lu}\p{Ll}+)?,?[ \t](?:[A-Z]{2}[ \t])?(?:\d{5}|[A-Z]{1,2}\d{1,2}[A-Z]?[ \t]\d[A-Z]{2})(?!\w))"),
    re.compile(r"(?<![\w-])\p{Lu}[\p{Ll}ß]{3,}(?:[ -](?!A[nm]\b|I[mn]\b|Auf\b|Vor\b|Zu)\p{Lu}[\p{Ll}ß]+)?[ -](?:Straße|Strasse|Str\.|Weg|Platz|Allee|Gasse|Ring|Damm|Ufer)[ ]\d{1,4} ?[a-z]?(?!\w)"),
    re.compile(r"(?<!\w)(?:P\.? ?O\.? ?Box|Post Office Box|Postfach|Boîte postale|BP) \d{1,6}(?!\w)"),
    re.compile(r"(?<!\w)(?:(?:Am|An der|An den|Im|In der|Zum|Zur|Auf der) )?[A-ZÄÖÜ][a-zäöüß-]*(?:straße|strasse|str\.|weg|platz|allee|gasse|ring|damm|ufer|steig) \d{1,4} ?[a-z]?(?!\w)"),
    re.compile(r"(?<![\w.,+-])\d{1,4}(?: ?(?:bis|ter|quater))?,? (?:rue|avenue|boulevard|place|chemin|allée|quai|impasse|route|square)(?: (?:des|du|de la|de|d['’]))? ?[^\W\d_][\w'’-]+"),
    re.compile(r"(?:(?<=[到在于至是址往：:，,。 ])[\p{Han}]{2,4}|[\p{Han}]{2})(?:市|县|区|镇)[\p{Han}]{1,8}?(?:路|街|道|巷|弄)\d+号(?:\d+(?:单元|栋|幢|座))?(?:\d+室)?"),
]

# Names: shapes of two parts, weighed by what is known of the parts and by the words on either side.
_CAP, _LOW, _UP = r"\p{Lu}[\p{Ll}'’]+(?:\p{Lu}\p{Ll}+)?", r"\p{Ll}[\p{Ll}'’]+", r"\p{Lu}{3,}"
_TWO = rf"{_CAP}(?:-{_CAP})?"
SHAPES = re.compile(
    rf"(?:{_UP}(?:-{_UP})?,[ \t]{_TWO}|{_TWO}[ \t](?:\p{{Lu}}\.[ \t]?)?{_TWO}|(?:\p{{Lu}}\.[ \t]?){{1,2}}{_TWO}"
    rf"|{_TWO}[ \t](?:\p{{Lu}}\.[ \t]?)?{_UP}(?:-{_UP})?|{_UP}[ \t](?:\p{{Lu}}\.[ \t]?)?{_UP}(?:-{_UP})?|{_TWO},[ \t]{_TWO})(?![\p{{L}}\d@])"
)
LOWER = re.compile(rf"(?:{_LOW}[ \t](?:\p{{Ll}}\.[ \t]?)?{_LOW}(?:-{_LOW})?|\p{{Ll}}\.[ \t]?{_LOW}(?:-{_LOW})?|{_LOW},[ \t]{_LOW})(?![\p{{L}}\d@])")
TOKEN = stdre.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
# Titles; greetings and thanks; words for a role, as labels; words after which a person may stand; what persons do.
TITLES = frozenset("mr mrs ms miss dr prof professor sir herr frau mme mlle madame monsieur".split())
GREETINGS = frozenset("hi hello hey dear thanks regards cheers best sincerely hallo liebe lieber grüße gruß danke bonjour cher chère merci cordialement cc attn".split())
ROLES = frozenset("by name author reporter coach player trainer spieler joueur contact customer client patient user member visitor visitors guest owner manager editor teacher doctor colleague employee participant athlete student from to attendee assignee reviewer".split())
AGENTS = frozenset("by with from to of for and or since until ask asks asked tell told call contact meet met per via says said invoice mail email write send forward von bei mit für an durch laut und bitte frag seit zu de par à avec chez selon pour et contactez appelez".split())
DOES = frozenset(
    "wants wanted want said says told tells asked asks wrote writes called calls moved moves changed changes lives lived works worked arrived arrives came comes went goes thinks thought believes likes liked made makes sent sends got gets has had is was will would can could and joined left plays played met signed reported noted added "
    "wohnt wohnte schrieb schreibt sagt sagte fragt fragte kam kommt ging möchte will hat war ist und habite a est dit écrit demande veut et".split()
)
# Given names in wide use; those that are words as well need a cue.
GIVEN = frozenset(
    "adam alan albert alex alexander alice amanda amelia amy ana andrea andreas andrew anna anne anthony antonio arthur barbara benjamin bernard brian camille carl carlos caroline catherine charles charlotte chloe chris christian christina christine christopher claire clara claudia daniel david dennis diana "
    "diego donald edward elena elisabeth elizabeth ella emily emma eric erik eva felix fernando florian franz gabriel george giovanni gregory hannah hans heinrich helen henry hugo ian ingrid isabella ivan jacob jacques james jane janet jason javier jean jennifer jessica joan johann john jonas jonathan jorge joseph "
    "juan julia julian julie jürgen karen karl katharina katherine kenneth kevin klaus laura lauren leon leonard linda lisa louis louise lucas lucia luis lukas luke manuel marco margaret maria marie mario martha martin mary matthew max melissa michael michelle miguel mohammed nancy natalie nicholas nicole nina noah "
    "ivo leif liv marek nadia olga oliver olivia oscar pablo pamela patricia patrick paul pedro peter philip pierre rachel rafael raymond rebecca ricardo richard robert roberto roger ruth ryan samuel sandra sara sarah scott sebastian sergio simon sofia sophia sophie stefan stephanie stephen steven susan teresa theodore thomas timothy valentina vanessa victor victoria vincent virginia walter william wolfgang zoe".split()
)
GIVEN_WORDS = frozenset("april art august bill bob chase dawn drew eve faith frank gene grace grant harry hope iris ivy jack joy june lily mark may max miles olive pat penny ray rich rob rose ruby rusty sandy skip sue summer tom violet will".split())
# Words that end or begin names of places, groups and things rather than persons.
THINGS = frozenset(
    "lab coach range links seven four iron hybrid box lane road street avenue st apt club team park school center centre bay lake north south east west driver putter wedge university college hospital hotel airport station river island bridge county city town village valley beach mountain mount museum church library company group inc ltd gmbh bank office menu morning evening night day week month monday tuesday wednesday thursday friday saturday sunday "
    "january february march april june july september october november december gate green hollow tarn lower upper new old great saint port fort san los santa royal united international national central".split()
)
LABEL = re.compile(r"(?:(?:^|[\W_])(?P<role>\p{L}+)(?:\"|')?[ \t]?[:=][ \t]*[\"']?|(?P<cell>\|[ \t]+)|(?P<sign>(?:^|\s)--[ \t]*\r?\n)|(?P<ask>\b(?:ask for|attention of)[ \t]+))$")
LEFT = re.compile(r"(?P<word>\p{L}+)(?P<mark>\.|,|;)?[ \t]*$")
RIGHT = re.compile(r"[ \t]+(?P<word>\p{L}+)")
LIST = re.compile(r"(?:,[ \t]+|[ \t]+(?:and|und|et|&|y)[ \t]+)(?:\p{L}+\.?[ \t]+)?")
# Chinese family names of two characters.
DOUBLE = "欧阳|司马|上官|诸葛|司徒|闻人|濮阳|澹台|东方|公孙|慕容|皇甫|尉迟|长孙|宇文|夏侯|令狐|独孤|南宫|端木"
HAN_NAME = rf"(?P<name>(?:{DOUBLE})\p{{Han}}{{1,2}}|\p{{Han}}{{2,3}})"
# Frequent Chinese family names that begin few other words; what follows a person at the start of a clause.
HAN_FAMILY, HAN_DOES = "王李张刘陈杨赵吴徐孙朱胡郭罗郑梁谢宋唐许邓冯韩曹彭蔡潘袁蒋杜魏吕沈姚卢傅姜崔谭廖", "昨天|今天|明天|昨晚|今早|刚才|已经|说|来|去|在|把|给|和|跟|打电话|先生|女士|老师|教练|医生|同学"
HAN = [re.compile(rf"(?:^|(?<=[\s，。；：！？、,.;:!?]))(?P<name>(?:{DOUBLE}|[{HAN_FAMILY}])\p{{Han}}{{1,2}}?)(?={HAN_DOES})"), re.compile(rf"(?:由|请)(?:联系)?{HAN_NAME}(?=复核|审核|记录|负责|检查|确认|，)"), re.compile(rf"(?:联系人?|收件人|姓名|教练|球员|联系)[是为：:]?{HAN_NAME}(?=[，。,.；;、\s]|$)")]


@dataclass(frozen=True)
class Lexicon:
    """common: whole words of vocabularies, whatever their case; small: those that vocabularies with case have in small letters;
    plain: common ones that are no given names."""

    common: frozenset[str]
    small: frozenset[str]
    plain: frozenset[str]


@lru_cache(maxsize=2)
def lexicon(words: str, cased: tuple[str, ...]) -> Lexicon:
    """What the vocabularies of public tokenizers tell of words; a missing file is an error."""
    with open(words, encoding="utf-8") as f:
        common = frozenset(re.findall(r'"(\p{Ll}{2,})</w>"', f.read()))
    small = set()
    for path in cased:
        with open(path, "rb") as f:
            for line in f:
                t = base64.b64decode(line.split()[0])
                if t[:1] == b" " and len(t) > 2:
                    w = t[1:].decode("utf-8", "ignore")
                    if w.isalpha() and w == w.lower():
                        small.add(w)
    return Lexicon(common | small, frozenset(small), (common | small) - GIVEN - GIVEN_WORDS)


def normalise(text: str) -> tuple[str, list[int] | None, list[int] | None]:
    """The rewritten text and where each of its characters begins and ends in the source; None where nothing moved."""
    at = to = None
    out = text
    if not text.isascii():
        out = text.translate(ONE_TO_ONE)
        if HIDDEN.search(out):
            at = [i for i, c in enumerate(text) if c not in INVISIBLE]
            to = [i + 1 for i in at]
            out = HIDDEN.sub("", out)
    low = out.lower()
    some_at, some_dot = any(x in low for x in ("at)", "at]", "at}", "at>")) or " AT " in out, any(x in low for x in ("dot)", "dot]", "dot}", "dot>", " dot "))
    for rule, put in ((SAID, None), (AT, "@"), (DOT, "."), (SPELLED, None)):
        if rule is AT and not some_at or rule is DOT and not some_dot or rule is SAID and not (" at " in low and " dot " in low):
            continue
        if rule is SAID:
            hits = [h for m in SAID.finditer(out) for h in SAID_PART.finditer(out, m.start(), m.end())]
        else:
            hits = list(rule.finditer(out))
        if rule is AT or rule is DOT:  # plain words count only in capitals or brackets
            hits = [h for h in hits if h.group().strip()[0] in "[({<" or h.group().strip().isupper()]
        if not hits:
            continue
        at, to = at or list(range(len(out))), to or list(range(1, len(out) + 1))
        parts, begins, ends, last = [], [], [], 0
        for h in hits:
            new = put if put else {"at": "@", "dot": "."}[h.group(1).lower()] if rule is SAID else "".join(DIGITS[w.lower()] for w in re.findall(r"\w+", h.group()))
            parts += [out[last : h.start()], new]
            begins += at[last : h.start()] + [at[h.start()]] * len(new)
            ends += to[last : h.start()] + [to[h.end() - 1]] * len(new)
            last = h.end()
        parts.append(out[last:])
        at, to = begins + at[last:], ends + to[last:]
        out = "".join(parts)
    return out, at, to


def _no_phone(s: str, a: int) -> bool:
    """Whether what stands before a number makes it a count or the number of something."""
    while a > 0 and s[a - 1] in " =:#\t":
        a -= 1
        if s[a] == "#":
            return True
    if a and s[a - 1] in "$€":
        return True
    w = _COUNTED.search(s[max(0, a - 24) : a])
    return bool(w) and (w.group(1).lower() in NOT_PHONE or w.group(1)[-1] == "-")


_LETTERS, _ELIDED = re.compile(r"\p{L}+"), re.compile(r"(?:^|[ \t])(?:[cdjlmnst]|qu)['’]")
_WORD_LEFT, _WORD_RIGHT = re.compile(r"(\p{L}{2,})[ \t\n]+$"), re.compile(r"[ \t\n]+(\p{L}{2,})")
_HAN, _DIGITS, _COUNTED = re.compile(r"\p{Han}"), stdre.compile(r"\d[^\n]{0,3}\d"), re.compile(r"(?:^|[^\p{L}])(\p{L}+|\p{Lu}-)$")


class _Names:
    """Weighs the shapes of names in a text."""

    def __init__(self, text: str, words: Lexicon, taken: list[tuple[int, int]] | None = None):
        self.taken = taken or []
        self.text, self.words, self.small, self.plain, self.last = text, words.common, words.small, words.plain, -1

    def is_taken(self, a: int) -> bool:
        k = bisect_right(self.taken, (a, 1 << 60))
        return k > 0 and self.taken[k - 1][1] > a

    def cues(self, a: int, b: int) -> tuple[bool, bool, bool]:
        """(named, cued, acts): a title or label right before, a word that leads to a person before, one that persons do after."""
        s = self.text
        left = s[max(0, a - 48) : a]
        named = cued = False
        tail = left.rstrip(" \t")[-1:]
        if tail and (tail in ":=\"'|\n" or left[-4:-1] in ("for", " of")) and (m := LABEL.search(left)):
            role = (m.group("role") or "").lower()
            # a subject is a person as a field of data, in quotes, and a topic elsewhere
            named = not role or role in ROLES or role.endswith("by") or (role == "subject" and left[m.start("role") - 1 : m.start("role")] in ("'", '"'))
        if not named and (m := LEFT.search(left)):
            w, mark = m.group("word").lower(), m.group("mark")
            if w in TITLES and mark in (None, "."):
                named = True
            elif w in GREETINGS and mark in (None, ","):
                cued = True
            elif not mark and w in AGENTS:
                cued = True
            elif mark == "," and w in ROLES:
                cued = True
            elif not mark and w in ROLES and w not in AGENTS:
                cued = True
        if self.last >= 0 and LIST.fullmatch(s, self.last, a):
            cued = True
        r = RIGHT.match(s, b)
        return named, cued, bool(r) and r.group("word").lower() in DOES

    def accept(self, a: int, b: int) -> bool:
        s = self.text[a:b]
        parts = _LETTERS.findall(s)
        long = [p for p in parts if len(p) > 1]
        if not long or (len(parts[0]) > 1 and parts[0].lower() in NO_NAME) or long[-1].lower() in OPENERS:
            return False
        comma = "," in s
        family, first = (long[0], long[-1] if len(long) > 1 else "") if comma else (long[-1], parts[0] if len(parts[0]) > 1 else "")
        family, first = family.lower(), first.lower()
        rare = len(family) > 3 and not any(w in self.words for w in (family, *(family[: -len(e)] for e in ENDINGS if family.endswith(e))))
        given = first in GIVEN
        unknown = not first or not any(w in self.small for w in (first, *(first[: -len(e)] for e in ENDINGS if first.endswith(e) and len(first) > len(e) + 3)))
        named, cued, acts = self.cues(a, b)
        thing = any(p.lower() in THINGS for p in long)
        if s == s.lower():
            if _ELIDED.search(s):  # an elided article or pronoun
                return False
            start = a == 0 or self.text[a - 1] == "\n" or self.text[max(0, a - 2) : a] in (". ", "! ", "? ", ": ", "; ", "- ")
            led = named or cued or (acts and start)
            if thing and not named:
                return False
            if not led:  # right after the, before its noun, only words that nothing else explains
                the = self.text[max(0, a - 4) : a] in ("the ", "The ")
                noun = RIGHT.match(self.text, b)
                return the and rare and (given or unknown and not first.endswith(QUALITIES)) and not family.endswith("s") and bool(noun) and noun.group("word").lower() not in NO_NOUN
            return rare and unknown if not given else rare or named or cued
        if s == s.upper() and not comma and not named and len(first) > 1:  # in a run of capitals shapes tell nothing
            near = _WORD_LEFT.search(self.text[max(0, a - 32) : a]), _WORD_RIGHT.match(self.text, b)
            if any(m and m.group(1).isupper() for m in near):
                return False
        if comma and not (rare or named):
            return False
        if comma and s.split(",")[0] != s.split(",")[0].upper() and not (named or cued or acts):
            return False
        if thing:
            return named and rare or (given and family not in THINGS)
        if named or (rare and (unknown or given or cued or acts or s != s.upper())):
            return True
        if given:
            return True
        if first in GIVEN_WORDS or (first and first[-1] == "s" and first in GIVEN_WORDS):
            return cued or acts
        return (cued or acts) and unknown and bool(first) and len(first) > 2

    def find(self) -> Iterator[tuple[int, int]]:
        s, plain = self.text, self.plain
        low = [w.lower() for w in TOKEN.findall(s)]
        some = [i for i, w in enumerate(low) if w not in plain and w[0] <= "\u024f"]
        titled = [i + 1 for i, w in enumerate(low[:-1]) if w in TITLES and low[i + 1] in plain]
        if not some and not titled:
            return
        spans, done = [m.span() for m in TOKEN.finditer(s)], 0
        for i in sorted({*some, *titled}):
            x, y = spans[i]
            if x < done or (low[i] in plain and not s[x].isupper()):
                continue
            for j in (i - 2, i - 1, i):
                if j < 0 or spans[j][0] < done or x - spans[j][0] > 120:
                    continue
                a = spans[j][0]
                if self.is_taken(a):
                    continue
                if a and (s[a - 1] in "@-’'" or s[a - 1] == "." and a > 1 and s[a - 2].isalnum()) and not s.startswith("--", a - 2):
                    continue
                m = SHAPES.match(s, a) if s[a].isupper() else LOWER.match(s, a)
                if m and m.end() >= y and self.accept(a, m.end()):
                    self.last = done = m.end()
                    yield a, done
                    break


def find(text: str | None, words: Lexicon) -> list[tuple[str, int, int]]:
    """(kind, start, end) of each occurrence, places in code points from 0, in order and without overlap; words are lexicon()."""
    if not text:
        return []
    out, at, to = normalise(text)
    taken: list[tuple[int, int]] = []
    found: list[tuple[str, int, int]] = []

    def take(kind: str, a: int, b: int) -> None:
        k = bisect_left(taken, (a, b))
        if (k and taken[k - 1][1] > a) or (k < len(taken) and taken[k][0] < b):
            return
        taken.insert(k, (a, b))
        found.append((kind, at[a] if at else a, to[b - 1] if to else b))

    if "@" in out:
        for m in EMAIL.finditer(out):
            take("email", *m.span())
    for rule in ADDRESSES:
        for m in rule.finditer(out):
            take("address", *_to_town(out, *m.span()))
    if _DIGITS.search(out):
        for rule in IDS:
            for m in rule.finditer(out):
                take("id_number", *m.span())
        for rule in PHONES:
            for m in rule.finditer(out):
                if sum(c.isdigit() for c in m.group()) >= 9 and not _no_phone(out, m.start()):
                    take("phone", *m.span())
    for a, b in _Names(out, words, taken[:]).find():
        take("name", a, b)
    if _HAN.search(out):
        for rule in HAN:
            for m in rule.finditer(out):
                take("name", *m.span("name"))
    return sorted(found, key=lambda x: x[1])


#: Words that open a sentence before a name rather than belong to it.
OPENERS = frozenset("the this that a an and or but if since when while after before according please hi hello dear thanks cc call ask coach player swing range task every each our whoever nothing nobody for at on in with to from le la les un une des pour merci der die das den dem ein eine am im bitte laut größere aufgabe für unser unsere sein seine ihr ihre mein meine dein kein keine jede jeder jedes dieser diese dieses nach vor mit ohne sobald während weil obwohl damit nachdem bevor ältere älteres grüße von zum zur bei aus und oder not so as is was".split())
DETERMINERS = frozenset("one another my your his her our their some no both few many much more most what which whose".split())
QUALITIES = ("ed", "less", "ing", "ous", "ful", "ish", "able", "al", "ic")
#: Endings of words whose stem makes them words.
ENDINGS = ("s", "es", "ed", "er", "d", "r", "ing")
NO_NAME = (OPENERS | AGENTS | GREETINGS | TITLES | ROLES | DOES) - GIVEN_WORDS
NO_NOUN = NO_NAME | DETERMINERS
_TOWN = re.compile(r"(?:,? ?(?:Apt|Apartment|Unit|Suite|Flat)\.? ?\w+)?(?:(?:,[ \t]*|[ \t]*\r?\n|[ \t]+-[ \t]+)(?:\d{5}[ \t]+)?\p{Lu}[\p{Ll}]+(?:-\p{Lu}\p{Ll}+)*(?:[ \t]+\d{5}(?!\d))?)?")


def _to_town(s: str, a: int, b: int) -> tuple[int, int]:
    m = _TOWN.match(s, b)
    return (a, m.end()) if m else (a, b)


def redact(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with each span replaced by its kind in brackets; all else is kept as it is."""
    if text is None:
        return None
    out, last = [], 0
    for kind, a, b in spans:
        out += [text[last:a], f"[{kind.upper()}]"]
        last = b
    return "".join([*out, text[last:]])


def find_personal(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: str = WORDS, cased: tuple[str, ...] = CASED) -> DataFrame:
    """(id, spans, redacted) of every document: spans of (kind, start, end), places in code points from 1, end inclusive.

    Null and empty texts have no spans and stay as they are. One pass over whole texts, without a shuffle.
    """

    # vocabularies are of a fixed size; workers need not have their files
    known = docs.sparkSession.sparkContext.broadcast(lexicon(words, cased))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            spans = [find(t, known.value) for t in b["__text"]]
            yield pd.DataFrame({"__id": b["__id"], "spans": [[{"kind": k, "start": x + 1, "end": y} for k, x, y in s] for s in spans], "redacted": [redact(t, s) for t, s in zip(b["__text"], spans)]})

    kind = dict(docs.dtypes)[id_col]
    d = docs.select(F.col(id_col).alias("__id"), F.col(text).alias("__text"))
    return spread(d).mapInPandas(run, f"__id {kind}, spans {SPAN}, redacted string").withColumnRenamed("__id", id_col)
