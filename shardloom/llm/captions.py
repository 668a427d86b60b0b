"""Addresses and captions in the form in which two of them are compared."""

from __future__ import annotations

import html
import re
import unicodedata
from functools import lru_cache

#: Parameters that say where a visitor came from and choose no resource.
TRACKING = frozenset("gclid fbclid dclid msclkid yclid igshid mc_cid mc_eid ref_src ref_url ref referrer source_ref spm _ga".split())
TRACKING_PREFIX = "utm_"
#: Cyrillic and Greek letters that look like Latin ones.
LOOKALIKES = str.maketrans("асеорхуіѕјԁһкмтвнАВСЕНІЈКМОРЅТХУοαερυικντχΑΒΕΖΗΙΚΜΝΟΡΤΥΧıł", "aceopxyisjdhkmtbhabcehijkmopstxyoaepuikvtxabezhikmnoptyxil")
#: What sites put before and after a description.
BEFORE = re.compile(r"^(?:\W|\[[^\]]{1,20}\]|(?:stock (?:image|photo|picture)|photo|image|picture|pic|caption|title|img|hd|new|figure|fig\.?)\s*[:\-–—|]|\d{1,3}[.)]\s)+", re.I)
AFTER = re.compile(
    r"(?<![\s\W])(?>\s*+(?:[-–—|,;:(\[]\s*+)*+(?:stock (?:image|photo|picture)s?|free download|royalty free|high resolution|archived copy|original|more|read more|download|hd|4k|reposted|photo|image|"
    r"see more at\s+\S+|(?:photo )?(?:via|credit:?|courtesy of|source:?)\s+\S+|(?:https?://|www\.)\S+)\s*[)\]]*\s*|[\s\W])+$",
    re.I,
)
INSIDE = re.compile(r"\s*(?:,\s*via [^,]{1,30}(?=,)|\s-\sstock (?:photo|image)(?=,)|\[(?:hd|archived copy|more)\]|\((?:original|archived copy)\)|\|\s*free download(?=,)|see more at\s+\S+?(?=,\s))", re.I)
#: What has to be there for them to match at all.
INSIDE_MARKS = (", via ", " - stock ", "[", "(", "|", "see more")
AFTER_ENDS = tuple("stock download royalty resolution archived copy original more hd 4k reposted photo image photos images free picture pictures".split())
AFTER_MARKS = ("via ", "credit", "courtesy", "source", "http", "www.", "see more")
TAG = re.compile(r"</?[a-z][^<>]{0,200}>", re.I)
WORD = re.compile(r"[^\W_]+")

UNRESERVED = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._~")


def _decoded(text: str) -> str:
    """Percent codes of unreserved characters resolved, others in upper case."""
    if "%" not in text:
        return text

    def one(m: re.Match) -> str:
        b = int(m[1], 16)
        return chr(b) if b in UNRESERVED else "%" + m[1].upper()

    while (out := re.sub("%([0-9A-Fa-f]{2})", one, text)) != text:
        text = out
    return text


def resource(url: str | None) -> str | None:
    """One spelling for all addresses of a resource, whatever the protocol; null for none.

    Host in lower case without ``www.``, default port, user and trailing dot;
    percent codes, dot segments and doubled slashes resolved; fragment and
    tracking parameters dropped; other parameters in order. The case of paths
    and parameters is kept.
    """
    if not url or not url.strip():
        return None
    s = url.strip()
    s = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*://|^//", "", s)
    s = s.partition("#")[0]
    s, _, query = s.partition("?")
    host, _, path = s.partition("/")
    host = _decoded(host.rpartition("@")[2]).lower()
    name, _, port = host.partition(":")
    name = name.rstrip(".")
    if name.startswith("www."):
        name = name[4:]
    if port and port not in ("80", "443"):
        name += ":" + port
    out: list[str] = []
    for part in _decoded(path).split("/"):
        if part == "..":
            if out:
                out.pop()
        elif part not in (".", ""):
            out.append(part)
    kept = sorted(p for p in _decoded(query).split("&") if p and not _tracks(p.partition("=")[0]))
    return name + "/" + "/".join(out) + ("?" + "&".join(kept) if kept else "")


def _tracks(name: str) -> bool:
    name = name.lower()
    return name in TRACKING or name.startswith(TRACKING_PREFIX)


def bare(caption: str) -> str:
    """A caption without markup, entities and what sites put around it, in plain lower-case letters."""
    s = caption
    if "&" in s:
        s = html.unescape(html.unescape(s))
    if "<" in s:
        s = TAG.sub("", s)
    if not s.isascii():
        s = unicodedata.normalize("NFKD", s)
        s = "".join([c for c in s if not (unicodedata.combining(c) or unicodedata.category(c) == "Cf")]).translate(LOOKALIKES)
    s = " ".join(s.split()).lower()
    if any(mark in s for mark in INSIDE_MARKS):
        s = INSIDE.sub("", s)
    if m := BEFORE.match(s):
        s = s[m.end() :]
    s = s.rstrip(" .,;:!?…-–—|\"'”’")
    if s.endswith(AFTER_ENDS) or any([mark in s for mark in AFTER_MARKS]) or s[-1:] in ")]":
        s = AFTER.sub("", s)
    return s


def words(caption: str | None) -> list[str]:
    """The words of a bare caption, hyphens apart."""
    return WORD.findall(bare(caption)) if caption else []


#: Common words, which an edit may add or leave out and which tell running language.
COMMON = frozenset(
    "the of and to in is was it for on with as by at from are were be this which who or not that had their into near one where under while now "
    "der die das und ist ein eine einen im den dem von zu mit auf nicht des es wird steht aus liegt während daneben am "
    "el la los las de del que y en un una por con no para su al se donde desde sin nadie junto "
    "le les des du et une dans est qui pour pas sur au par ne que personne devant près depuis".split()
)
#: Words an edit adds around a description.
ADDED = frozenset("photo picture image stock original archived copy more free download via hd fig figure title caption see source credit".split())


def running(tokens: list[str], least: int = 8) -> bool:
    """Whether the words are running language of ``least`` words or more."""
    if len(tokens) < least:
        return False
    common = [t for t in tokens if t in COMMON]
    numbers = sum(t.isdigit() for t in tokens)
    return len(common) >= 0.12 * len(tokens) and len(set(common)) >= 2 and numbers <= 0.3 * len(tokens)


@lru_cache(maxsize=1 << 17)
def slips(a: str, b: str) -> bool:
    """Whether two different words differ by a slip or, from six letters on, by two.

    A slip adds, drops or changes a letter or swaps two neighbours.
    """
    la, lb = len(a), len(b)
    # one of the first letters is still there unless it is what was changed
    if a[0] != b[0] and a[0] != b[1:2] and a[1:2] != b[0] and a[1:] != b[1:]:
        return False
    limit = 2 if min(la, lb) >= 6 else 1
    if abs(la - lb) > limit or min(la, lb) < 3 or not (a.isalpha() and b.isalpha()):
        return False
    older: list[int] = []
    old = list(range(lb + 1))
    for i in range(1, la + 1):
        row = [i]
        for j in range(1, lb + 1):
            d = min(old[j] + 1, row[-1] + 1, old[j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d = min(d, older[j - 2] + 1)
            row.append(d)
        if min(row) > limit:
            return False
        older, old = old, row
    return old[-1] <= limit


def same_description(a: list[str], b: list[str], frequent) -> bool:
    """Whether two captions give the same description, perhaps slightly altered.

    Words may be moved, misspelt, left out or added around; a word in the place
    of another makes them differ. ``frequent(word)`` says that a word is so
    common in the collection that it is no misspelling.
    """
    count: dict[str, int] = {}
    for t in b:
        count[t] = count.get(t, 0) + 1
    only_a: list[int] = []
    for i, t in enumerate(a):
        n = count.get(t, 0)
        if n:
            count[t] = n - 1
        elif len(t) > 2 or t.isdigit():
            only_a.append(i)
    common = len(a) - len(only_a)
    only_b: list[int] = []
    for i in range(len(b) - 1, -1, -1):
        t = b[i]
        if count[t]:
            count[t] -= 1
            if len(t) > 2 or t.isdigit():
                only_b.append(i)
    left_a: list[int] = []
    for i in only_a:
        t = a[i]
        for k, j in enumerate(only_b):
            u = b[j]
            if (i == len(a) - 1 and len(t) >= 3 and u.startswith(t)) or (j == len(b) - 1 and len(u) >= 3 and t.startswith(u)) or (slips(t, u) and not (frequent(t) and frequent(u))):
                del only_b[k]
                common += 1
                break
        else:
            if t not in COMMON:
                left_a.append(i)
    left_b = [j for j in only_b if b[j] not in COMMON]
    # what is shared must be most of the shorter one and half of the longer one
    if common < 0.6 * min(len(a), len(b)) or common < 0.45 * max(len(a), len(b)) or common < 6:
        return False
    if not left_a or not left_b:
        return True
    left_a = [i for i in left_a if a[i] not in ADDED]
    left_b = [j for j in left_b if b[j] not in ADDED]
    # left out here and there, or one in the place of the other?
    for i in left_a:
        for j in left_b:
            if i and j and a[i - 1] == b[j - 1] or i + 1 < len(a) and j + 1 < len(b) and a[i + 1] == b[j + 1]:
                return False
    # a run of words in the place of another
    return not (left_a and left_b) or len(left_a) + len(left_b) <= 3
