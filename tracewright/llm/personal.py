r"""Personal items inside free text, by a skip-chain conditional random field.

Every place that has the shape of an item (mailbox, phone number, official number, street address, full
name) is a node with the variable item / no item. Its own potential comes from its shape, from whether its
words are frequent words, names or neither, and from the sort of words and marks around it. Neighbours in a
line are joined as in a chain; distant nodes that repeat or resemble each other (the same name, a name and
the mailbox made of it) are joined by skip edges, which share their potentials, so that a name met once in a
clear frame is known in an unclear one. Loopy message passing gives marginals; overlapping nodes are settled
by the greater one.

All weights, those of the edges too, are fitted by penalised pseudo-likelihood on drawn documents (module
`drawn`): the data has no labels, and no text of it is used. Which words are frequent is read from the
vocabulary file of a public tokenizer (`vocabulary`); without the file every word counts as unknown.

Defined cases: null and empty texts hold nothing and stay as they are; each different value of a kind
counts once for a text; repeated rows count once; null keys stay null; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import math
import os
import re
import unicodedata
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import drawn
from tracewright.llm.drawn import GIVEN
from tracewright.session import spread, table

KINDS = ("email", "phone", "id_number", "address", "name")
ROUNDS = 6
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def _letters(category: str) -> str:
    """The Latin, Greek and Cyrillic letters of a category, for a character class."""
    return "".join(chr(c) for c in [*range(0x41, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x1F00)] if unicodedata.category(chr(c)) == category)


_UP, _LO = _letters("Lu"), _letters("Ll")
_CAP = rf"(?:[{_UP}]['’]|Mc|Mac)?[{_UP}][{_LO}]+(?:-[{_UP}][{_LO}]+)*"
_ALL = rf"(?:[{_UP}]['’])?[{_UP}]{{2,}}(?:-[{_UP}]+)*"
_OF = "van von de da del der den di du la le dos das do ter ten bin al el zu zum af".split()
_PART, _PARTS = rf"(?: (?:{'|'.join(_OF)})){{0,3}}", rf"(?: (?:{'|'.join(x.upper() for x in _OF)})){{0,3}}"
_AT, _DOT = r"(?:@|\s?[\[({]\s?(?:at|AT)\s?[\])}]\s?|\s(?:at|AT)\s)", r"(?:\.|\s?[\[({]\s?(?:dot|DOT)\s?[\])}]\s?|\s(?:dot|DOT)\s)"
_EMAIL = re.compile(rf"(?<![\w.+/@-])[A-Za-z0-9][\w.+-]*{_AT}[A-Za-z0-9][A-Za-z0-9-]*(?:{_DOT}[A-Za-z0-9][A-Za-z0-9-]*)*{_DOT}[A-Za-z]{{2,24}}(?![\w@+-]|\s?[\[({{]\s?(?:at|AT)\b|[._][\w.+-]*@)")
_PHONE = re.compile(
    r"(?<![\w.+/:-])(?:(?:\+|00)[1-9]\d{0,2}[ .-]?(?:\(0?\d{1,4}\)[ .-]?)?\d{1,5}(?:[ .-]?\d{2,5}){1,5}|\(0?\d{2,4}\)[ .-]?\d{3,4}[ .-]\d{3,4}|0\d{2,4}[ /-]\d{3,6}(?:[ -]\d{2,5})?|[2-9]\d{2}[-.]\d{3}[-.]\d{4})(?![\w/]|[-.:]\d)"
)
_ID_LABEL = (
    r"(?:social security (?:number|no\.?)|ssn|national (?:id|insurance)(?: (?:number|no\.?))?|personal (?:id|identity)(?: (?:number|no\.?|code))?|identity (?:card|number)(?: (?:number|no\.?))?|id (?:card|number)|tax (?:id|number|no\.?|code)(?: of the \w+)?|passport(?: (?:number|no\.?))?"
    r"|driv(?:ing|er['’]?s?) licen[cs]e(?: (?:number|no\.?))?|dni|nie|nif|cpf|pesel|nino|ausweisnummer|personalausweis(?:nummer)?|reisepass(?:nummer)?|steuer-?id(?:nummer)?|sozialversicherungsnummer|numéro de sécurité sociale|carte d['’]identité|residence permit(?: no\.?)?|aadhaar|nhs(?: (?:number|no\.?))?|national insurance number|insurance number|personal code)"
)
_ID = re.compile(rf"(?i)\b{_ID_LABEL}\s*(?:[:=#]|is|no\.?|nr\.?)?\s*[\"']?(?P<v>[A-Z]{{0,5}}[ -]?\d[A-Z0-9]*(?:[ ./-][A-Z0-9]*\d[A-Z0-9]*){{0,5}})(?![\w-])|(?<![\w.-])(?P<s>\d{{3}}-\d{{2}}-\d{{4}})(?![\w-])")
_WORDS = rf"(?:[{_UP}][\w'’-]*\.? ){{1,4}}"
_ADDRESS = re.compile(
    rf"(?<![\w.])\d{{1,5}}[a-zA-Z]?(?: (?:bis|ter))?,? (?:rue|avenue|boulevard|place|chemin|allée|quai|impasse|route|cours)(?: (?:de la|de l['’]|des|du|de|d['’]))? ?[{_UP}][\w'’-]+(?: [{_UP}][\w'’-]+)*"
    rf"|\b(?:Calle|Avenida|Rua|Plaza|Paseo|Travessa|Praça|Camino|Via|Viale|Piazza|Carrer|Largo)(?: (?:de|dos|das|da|do|los|las|del|la|el|della|di))* [{_UP}][\w'’-]+(?: [{_UP}][\w'’-]+)*,? (?:n[.ºo°]\s?)?\d{{1,5}}[a-zA-Z]?(?!\w)"
    rf"|\b[{_UP}][\wßäöü-]*(?:straße|strasse|str\.|gasse|weg|platz|allee|ring|damm|ufer|steig|chaussee) \d{{1,4}}[a-z]?(?!\w)"
    rf"|(?<![\w.])\d{{1,5}}[A-Za-z]? {_WORDS}(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Crescent|Row|Drive|Dr|Court|Ct|Close|Way|Place|Terrace|Square|Sq|Boulevard|Blvd|Gardens|Mews|Parade|Walk|Grove|Hill|Park|Quay|Mansions|Villas|Circus|Rise|Vale|Alley|Parkway|Highway)(?!\w)(?:(?<=Rd|St|Dr|Ln|Ct|Sq)\.|(?<=Ave)\.(?= [a-z])|(?<=Blvd)\.)?"
)
_NOT_GIVEN = "Mr|Mrs|Ms|Miss|Dr|Prof|Sir|Herr|Frau|Señor|Señora|Monsieur|Madame|Bitte|Please|Ask|The|This|That|These|A|An|El|La|Le|Les|Los|Las|Der|Die|Das|Un|Una|I|We|It|In|On|At|By|To|Cc|Ping|Contact|Thanks|Reported|Signed|Tested|Reviewed|Co|Line|See|Run|Error|Version|When|If|Both|Tests|Fax|Her|His|Our|My|Each|One|Merge|Fix|Add|Note|Ticket|Sample|Half|Delivery|Wohnhaft|Telefon|Payload|Diese|Dieser|Dieses|Jede|Jeder|Neue|Neuer|Unser|Cette|Ce|Esta|Este|Essa"
_EDGE = r"(?![\w@/(]|\.\w|['’](?!s\b)\w)"
_RUN = re.compile(rf"(?<![\w@/.-])(?<!\w['’])(?:{_CAP}|{_ALL})(?: (?:{_CAP}|{_ALL}|[{_UP}]\.|{'|'.join(_OF)}))+{_EDGE}")
_COMMA = re.compile(rf"(?<![\w@/.-])(?<!\w['’])(?!(?:{_NOT_GIVEN})\b)(?:(?:(?<=[ \"'=])(?:van|von|de)(?: der| den| la)? )?{_CAP}, {_CAP}(?: [{_UP}]\.)?|(?:(?:VAN|VON|DE)(?: DER| DEN| LA)? )?{_ALL}, {_ALL}(?: [{_UP}]\.)?){_EDGE}")
_SCRIPT = re.compile(r"(?:-by: |[Nn]ame\"?\s?[:=]\s?\"?|[Aa]uthor: |[Cc]c: )(?P<v>[一-鿿]{2,4})(?![一-鿿])")
_LOW_LABEL = re.compile(rf"(?:-by: |\b[Nn]ame\"?\s?[:=]\s?[\"']?|\b[Aa]uthor: |\b[Cc]c: )(?P<v>[{_LO}]{{2,}}(?: [{_LO}]\.)?{_PART} (?:[{_LO}]['’])?[{_LO}-]{{2,}})(?![\w@/(.])")
_STARTERS = frozenset(_NOT_GIVEN.split("|"))
_LOW_NAME = re.compile(rf"(?:(?<=: )|(?<=[ (|\"'=;>-])|^)(?=([{_LO}]{{2,}}))(?:[{_LO}]{{2,}}(?: [{_LO}{_UP}]\.)*{_PART} (?:[{_LO}]['’])?[{_LO}-]{{4,}}|(?:van|von|de)(?: der| den| la)? [{_LO}]{{3,}}, [{_LO}]{{2,}}(?: [{_LO}{_UP}]\.)?|(?:[{_LO}]['’])?[{_LO}]{{4,}}, [{_LO}]{{2,}}(?: [{_LO}{_UP}]\.)?)(?![\w@/(])", re.M)
_LOW_GATE = re.compile(r"\b(" + "|".join(sorted(GIVEN | {"björn", "chloé", "josé", "joão"})) + r")\b|-by: [^\W\d_]|ame\"?\s?[:=]")
_LINE_WORDS = re.compile(r"[^\W\d_]+|[^\w\s]")
_GATE = re.compile(rf"@|\d{{3}}|\d[\d/ -]{{3}}|\b[Aa][Tt]\b|[{_UP}][{_LO}]*\.? [{_UP}]|[{_UP}], [{_UP}]|[{_LO}], [{_UP}]|\d [{_UP}]|[a-z] \d")


def fold(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))


@dataclass
class Node:
    kind: str
    start: int
    end: int
    value: str
    line: int
    tokens: frozenset
    features: list[str] = field(default_factory=list)


_SORTS = {
    "say": "said says wrote writes explained pointed noted asked reported mentioned suggested replied confirmed told thinks noticed complained found sees saw approved moved lives lived called has sagt schrieb hat wohnt dice vive escribió habite dit mora disse",
    "with": "please bitte by with from thanks thank via ping to for per hi hello dear ask asked contact contacted call credit according merci gracias obrigado danke von mit bei según selon segundo pour para con avec zu and und y et e de",
    "title": "mr mrs ms miss dr prof professor sir madam herr frau señor señora sr sra monsieur madame mme senhor senhora",
    "role": "author maintainer reviewer owner user customer client patient employee assignee reporter contact colleague name named person account usuario usuaria cliente clienta kunde kundin nutzer usuário utilisateur username fullname full_name cc",
    "thing": "page view screen flag button mode feature option job service module team lock guide table field menu tab dialog panel layer parser method api server setting settings widget banner toggle export import report dashboard release version spec section chapter code test tests support step",
    "place": "in at near im in nach en à em a au",
    "the": "the a an this that these our your new old der die das el la los las le les un una o os",
    "be": "is was are were be been ist war sind es fue est était é foi",
    "live": "live lives lived living office address adresse street ship shipped deliver delivery parcel letter label address_line1 wohnhaft wohnt vive habite mora dirección",
    "tel": "tel phone telephone telefon mobile cell fax call calls calling sms text ring reach dial hotline number whatsapp teléfono número tél phones contact under unter",
    "count": "line lines port version build run row rows id offset size range took epoch ms order ticket issue date page code hash commit rev revision",
    "mail": "mail email e-mail mails user login from sent send write signed account address to",
    "host": "clone git ssh scp remote url origin fetch pull push host",
    "on": "on turn when if use open see read after enable disable press click flag",
}
_SORT = {w: k for k, ws in reversed(_SORTS.items()) for w in ws.split()}


def _sort(token: str) -> str:
    low = token.lower()
    if low in _SORT:
        return _SORT[low]
    return token if not token[0].isalpha() else "Cap" if token[0].isupper() else "word"


def _context(text: str, a: int, b: int) -> list[str]:
    """The sorts of the words and marks around a place, inside its line."""
    lo, hi = text.rfind("\n", 0, a) + 1, text.find("\n", b)
    hi = len(text) if hi < 0 else hi
    lw, rw = [_sort(w) for w in _LINE_WORDS.findall(text[max(lo, a - 60) : a])], [_sort(w) for w in _LINE_WORDS.findall(text[b : min(hi, b + 40)])]
    l1, l2 = lw[-1] if lw else "^", " ".join(lw[-2:]) if len(lw) > 1 else "^"
    r1, r2 = rw[0] if rw else "$", " ".join(rw[:2]) if len(rw) > 1 else "$"
    return [f"l1={l1}", f"l2={l2}", f"r1={r1}", f"r2={r2}", f"lr={l1}|{r1}", f"alone={not lw and not rw}", f"by={text[max(lo, a - 5) : a].lower().endswith('-by: ')}"]


class Lexicon:
    """Whether a word is frequent in lower case, known with a capital only, or neither."""

    def __init__(self, path: str | None = VOCABULARY) -> None:
        self.low: dict[str, int] = {}
        self.cap: set[str] = set()
        if path and os.path.exists(path):
            with open(path, "rb") as file:
                for token, rank in map(bytes.split, file):
                    word = base64.b64decode(token).decode("utf-8", "replace")
                    if word[:1] == " " and len(word) > 3 and word[1:].isalpha():
                        if word[1:].islower():
                            self.low[word[1:]] = int(rank)
                        elif word[1:].istitle():
                            self.cap.add(word[1:].lower())

    def sort(self, word: str) -> str:
        if word in GIVEN:
            return "given"
        rank = self.low.get(word)
        if rank is not None:
            return "common" if rank < 25_000 else "word"
        return "proper" if word in self.cap else "rare"

    def frequent(self) -> list[str]:
        """Frequent words of four letters and more, to make feature names and filling of."""
        return sorted(w for w, r in self.low.items() if 300 < r < 20_000 and len(w) > 3 and w.isascii() and w not in GIVEN) or ["filling"]


def _name_spans(text: str) -> set[tuple[int, int]]:
    """Places of two to four capitalised words, with initials and particles between them, and other shapes of names."""
    spans = {(m.start(), m.end()) for m in _COMMA.finditer(text)}
    for m in _RUN.finditer(text):
        words, at = [], m.start()
        for w in m[0].split(" "):
            sort = "i" if w.endswith(".") else "o" if w.lower() in _OF else "U" if len(w) > 1 and w.isupper() else "C"
            words.append((at, at + len(w), sort, w))
            at += len(w) + 1
        for i, (a, _, sort, w) in enumerate(words):
            if sort not in "CU" or w in _STARTERS:
                continue
            taken = 1
            for _, end, other, _ in words[i + 1 : i + 9]:
                if other in "CU":
                    if other != sort:
                        break
                    taken += 1
                    spans.add((a, end))
                    if taken == 4:
                        break
    for g in _LOW_GATE.finditer(text):
        for m in (_LOW_NAME.match(text, g.start()), *_LOW_NAME.finditer(text, text.rfind("\n", 0, g.start()) + 1, g.end())):
            if m and g[1] and m.start() <= g.start() and m.end() >= g.end():
                spans.add((m.start(), m.end()))
    for pattern in (_LOW_LABEL, _SCRIPT):
        spans |= {m.span("v") for m in pattern.finditer(text)}
    return spans


def nodes_of(text: str, lexicon: Lexicon) -> list[Node]:
    out: list[Node] = []
    breaks = [m.start() for m in re.finditer("\n", text)]

    def add(kind: str, a: int, b: int, *features: str, tokens: frozenset = frozenset()) -> None:
        out.append(Node(kind, a, b, text[a:b], bisect_left(breaks, a), tokens, [f"{kind}:{f}" for f in ("bias", *features, *_context(text, a, b))]))

    for m in _EMAIL.finditer(text):
        v, after = m[0], text[m.end() : m.end() + 2]
        local = re.split(_AT, v)[0]
        shape = "plain" if "@" in v else "spelt" if re.search(r"[\[({]", v) else "words"
        add(
            "email", m.start(), m.end(), f"shape={shape}", f"remote={after[:1] == ':' and after[1:2].strip() != ''}", f"git={local in ('git', 'hg', 'svn')}",
            f"local={'sep' if re.search(r'[._+-]|[0-9]', local) else 'word'}|{shape}", f"hiddendot={bool(re.search(r'(?i)[\[({ ]dot[\])} ]', v))}",
            tokens=frozenset(x for x in re.split(r"[._+\-\d]+", fold(local)) if len(x) > 2),
        )
    for m in _PHONE.finditer(text):
        digits = sum(c.isdigit() for c in m[0])
        lead = "plus" if m[0][0] == "+" else "00" if m[0].startswith("00") else "(" if m[0][0] == "(" else "0" if m[0][0] == "0" else "us"
        add("phone", m.start(), m.end(), f"lead={lead}", f"count={'ok' if 9 <= digits <= 14 else 'odd'}", f"lead={lead}|{'ok' if 9 <= digits <= 14 else 'odd'}", tokens=frozenset([re.sub(r"\D", "", m[0])[-7:]]))
    for m in _ID.finditer(text):
        g = "v" if m["v"] is not None else "s"
        v = m[g]
        add("id_number", m.start(g), m.end(g), f"label={g == 'v'}", f"ssn={bool(re.fullmatch(r'\d{3}-\d{2}-\d{4}', v))}", f"long={sum(c.isdigit() for c in v) >= 5}|{g == 'v'}", tokens=frozenset([re.sub(r"\W", "", v.lower())]))
    for m in _ADDRESS.finditer(text):
        inner = [w for w in re.findall(r"[^\W\d_]+", fold(m[0])) if len(w) > 2 and w not in _OF]
        sorts = [lexicon.sort(w) for w in inner]
        add("address", m.start(), m.end(), f"form={'end' if m[0][-1].isdigit() or m[0][-2:-1].isdigit() else 'front'}", f"words={len(inner)}", f"sorts={'|'.join(sorts[:3])}", f"known={all(x in ('common', 'word') for x in sorts)}", tokens=frozenset([fold(m[0])]))
    for a, b in sorted(_name_spans(text)):
        v = text[a:b]
        words = [w for w in re.split(r"[ ,]+", fold(v)) if w and not re.fullmatch(r"\w\.", w) and w not in _OF]
        if len(words) < 2 and v.isascii():
            continue
        comma = "," in v
        first, last = (words[-1], words[0]) if comma else (words[0], words[-1])
        case = "low" if v == v.lower() else "up" if v == v.upper() else "cap"
        one, two = lexicon.sort(first), lexicon.sort(last.rpartition("-")[2])
        middle = bool(re.search(r"\b\w\. |\b\w\.$", v))
        prior, after = text[max(0, a - 12) : a], text[b : b + 6]
        right = re.match(r" ([^\W\d_]+)", text[b : b + 24])
        follow = lexicon.sort(right[1].lower()) if right and right[1].islower() else "-"
        add(
            "name", a, b, f"sorts={one}|{two}", f"first={one}|{case}", f"last={two}|{case}", f"comma={comma}|{one}", f"case={case}", f"middle={middle}", f"number={bool(re.match(r'\s*(?:\d|(?:bis|ter)\b)', after))}", f"zip={bool(re.search(r'\d{4,5} $', prior))}", f"count={bool(re.search(r'\d[a-z]?,? $', prior))}",
            f"the={bool(re.search(r'(?i)\b(?:the|a|an) $', prior))}", f"title={bool(re.search(r'(?i)\b(?:mr|mrs|ms|dr|prof|herr|frau)\.? $', prior))}", f"size={len(words)}", f"size={len(words)}|{'|'.join(lexicon.sort(w) for w in words[1:-1])}", f"mail={bool(re.match(r' ?[<(][^\s<>]+@', text[b : b + 40]))}", f"follow={follow}|{two}",
            f"join={prior.endswith(' ') and prior[:-1].rpartition(' ')[2][:1].isupper()}|{after[:1] == ' ' and after[1:2].isupper()}", tokens=frozenset(w for w in words if len(w) > 2) or frozenset([v]),
        )
    out.sort(key=lambda n: (n.start, -n.end))
    return out


def edges_of(nodes: list[Node]) -> list[tuple[int, int, str]]:
    """Chain edges inside a line, skip edges between nodes that repeat or resemble each other."""
    edges = [(i, i + 1, f"chain:{min(a.kind, b.kind)}|{max(a.kind, b.kind)}") for i, (a, b) in enumerate(zip(nodes, nodes[1:])) if a.line == b.line and b.start >= a.end]
    by: dict[tuple, list[int]] = defaultdict(list)
    for i, n in enumerate(nodes):
        if n.tokens:
            by[n.kind, n.tokens].append(i)
    for same in by.values():
        edges += [(a, b, f"skip:same:{nodes[a].kind}") for a, b in zip(same, same[1:])]
    heads = {}
    for i, n in enumerate(nodes):
        if n.kind == "name":
            for t in n.tokens:
                heads.setdefault(t, i)
    for i, n in enumerate(nodes):
        if n.kind == "email":
            near = {heads[h] for t in n.tokens for h in (t, t[1:]) if h in heads}
            edges += [(i, j, "skip:alike") for j in sorted(near)]
    return edges


class Field:
    """Weights of the random field and its inference."""

    def __init__(self, weights: dict[str, float], lexicon: Lexicon) -> None:
        self.weights, self.lexicon = weights, lexicon

    def marginals(self, nodes: list[Node], edges: list[tuple[int, int, str]]) -> list[float]:
        """Probability of each node to be an item; loopy messages as log-odds."""
        w = self.weights.get
        own = [sum(w(f, 0.0) for f in n.features) for n in nodes]
        if not edges:
            return [1 / (1 + math.exp(-max(-30.0, min(30.0, x)))) for x in own]
        messages: dict[tuple[int, int], float] = {}
        links: dict[int, list[tuple[int, float]]] = defaultdict(list)
        for a, b, kind in edges:
            j = w(kind, 0.0)
            links[a].append((b, j))
            links[b].append((a, j))
        for _ in range(ROUNDS):
            fresh = {}
            for a, out in links.items():
                total = own[a] + sum(messages.get((x, a), 0.0) for x, _ in out)
                for b, j in out:
                    h = max(-30.0, min(30.0, total - messages.get((b, a), 0.0)))
                    fresh[a, b] = math.log((1 + math.exp(j + h)) / (math.exp(j) + math.exp(h)))
            messages = fresh
        odds = [x + sum(messages.get((b, i), 0.0) for b, _ in links.get(i, ())) for i, x in enumerate(own)]
        return [1 / (1 + math.exp(-max(-30.0, min(30.0, x)))) for x in odds]

    def items(self, text: str) -> list[tuple[str, int, int]]:
        """(kind, start, end) of the items, from left to right."""
        if not text or not (_GATE.search(text) or _LOW_GATE.search(text)):
            return []
        nodes = nodes_of(text, self.lexicon)
        if not nodes:
            return []
        sure = self.marginals(nodes, edges_of(nodes))
        taken: list[tuple[int, int, str]] = []
        for p, n in sorted(zip(sure, nodes), key=lambda x: (KINDS.index(x[1].kind) // 4, -x[0], x[1].start - x[1].end, x[1].start)):
            if p < 0.5:
                continue
            at = bisect_left(taken, (n.start, n.end, n.kind))
            if (at == 0 or taken[at - 1][1] <= n.start) and (at == len(taken) or taken[at][0] >= n.end):
                taken.insert(at, (n.start, n.end, n.kind))
        return [(kind, a, b) for a, b, kind in taken]


def _examples(lexicon: Lexicon, documents: int, seed: int, frames: Sequence[str], decoys: Sequence[str]) -> list[tuple[list[Node], list[bool], str]]:
    draw = drawn.Draw(lexicon.frequent(), seed)
    out = []
    for _ in range(documents):
        text, gold = draw.document(frames, decoys)
        nodes = nodes_of(text, lexicon)
        out.append((nodes, [(n.start, n.end) in gold for n in nodes], text))
    return out


@functools.cache
def fitted_field(vocabulary: str = VOCABULARY, documents: int = 7_000, seed: int = 11, epochs: int = 150, ridge: float = 0.5, held_out: int | None = None) -> Field:
    """Logistic fit of each node given its neighbours' true values (pseudo-likelihood), with a ridge.

    Of edges only agreement is learned: their weights are kept from falling below 0. With `held_out` every
    fifth frame from that one on is left out, to be tested with.
    """
    lexicon = Lexicon(vocabulary)
    kept = lambda frames: [f for i, f in enumerate(frames) if held_out is None or i % 5 != held_out]
    names: dict[str, int] = {}
    rows, labels = [], []
    for nodes, y, _ in _examples(lexicon, documents, seed, kept(drawn.FRAMES), kept(drawn.LOOKALIKES)):
        around: dict[int, list[tuple[str, float]]] = defaultdict(list)
        for a, b, kind in edges_of(nodes):
            around[a].append((kind, 1.0 if y[b] else -1.0))
            around[b].append((kind, 1.0 if y[a] else -1.0))
        for i, n in enumerate(nodes):
            rows.append([(names.setdefault(f, len(names)), 1.0) for f in n.features] + [(names.setdefault(k, len(names)), v) for k, v in around[i]])
            labels.append(1.0 if y[i] else 0.0)
    index = np.concatenate([np.full(len(r), i) for i, r in enumerate(rows)])
    column, value = np.array([c for r in rows for c, _ in r]), np.array([v for r in rows for _, v in r])
    edge = np.array([i for k, i in names.items() if k.startswith(("chain:", "skip:"))], dtype=int)
    y, w, seen = np.array(labels), np.zeros(len(names)), np.full(len(names), 1e-8)
    for _ in range(epochs):
        z = np.bincount(index, weights=w[column] * value, minlength=len(y))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        grad = np.bincount(column, weights=((p - y)[index]) * value, minlength=len(w)) + ridge * w
        seen += grad**2
        w -= 0.5 * grad / np.sqrt(seen)
        w[edge] = np.maximum(w[edge], 0.0)
    return Field({f: float(w[i]) for f, i in names.items() if abs(w[i]) > 1e-3}, lexicon)


def mask(text: str, items: list[tuple[str, int, int]]) -> str:
    """The text with a typed placeholder in place of each item."""
    out, at = [], 0
    for kind, a, b in items:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join(out) + text[at:]


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = [table(spark, sf_dir, t).select("node_id", F.col(c).alias("text")) for t, c in (("commits", "message"), ("issues", "body"), ("pull_requests", "body"))]
    return each[0].unionByName(each[1]).unionByName(each[2])


def find_items(texts: DataFrame, key: str = "node_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, kind, value) of each different item of each text; one narrow pass, then a distinct."""
    sent = texts.sparkSession.sparkContext.broadcast(fitted_field(vocabulary))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        crf: Field = sent.value
        for batch in batches:
            rows = [(k, kind, t[a:b]) for k, t in zip(batch.iloc[:, 0], batch.iloc[:, 1]) for kind, a, b in crf.items(t)]
            yield pd.DataFrame(rows, columns=[key, "kind", "value"])

    return spread(texts.select(key, text).filter(F.length(text) > 0), key).mapInPandas(find, f"{key} string, kind string, value string").distinct()


def mask_items(texts: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """The same rows with the items in `text` replaced by typed placeholders."""
    sent = texts.sparkSession.sparkContext.broadcast(fitted_field(vocabulary))

    @F.pandas_udf("string")
    def masked(column: pd.Series) -> pd.Series:
        crf: Field = sent.value
        return column.map(lambda t: mask(t, crf.items(t)) if t else t)

    return texts.withColumn(text, masked(F.col(text)))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The personal items of commit messages, issue bodies and pull-request bodies."""
    return find_items(_texts(spark, sf_dir))


def p3_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts with placeholders."""
    return mask_items(_texts(spark, sf_dir))
