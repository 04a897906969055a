"""Drawn lines with and without personal items, to fit the random field of module `personal`.

The frames are of the general sort met in messages, letters, forms, records and logs; the items are put
together by rule: names from common given names and surnames or syllables, feature names from the frequent
words of a public vocabulary. None was taken from a data set.
"""

from __future__ import annotations

import random
import re
from collections.abc import Sequence

#: Common given names by language area, without marks.
GIVEN = frozenset(
    """james mary robert patricia john jennifer michael linda david elizabeth william susan richard jessica thomas sarah daniel emily matthew emma
    hans anna peter ursula klaus monika lukas lena jan julia stefan katharina pierre marie jean camille louis chloe nicolas claire antoine manon
    jose maria carlos lucia manuel carmen javier ana diego sofia pedro elena joao beatriz antonio ines rafael paula tiago mariana
    marco giulia luca francesca giovanni chiara paolo elisa lars ingrid erik astrid sven karin bjorn sigrid nils freja anders maja
    piotr katarzyna tomasz agnieszka jakub zofia pavel ivan olga dmitri natalia sergei irina andrei tatiana oleksandr
    mohamed fatima ahmed aisha ali layla omar yasmin hassan zeynep mehmet elif raj priya arjun anjali ravi deepa amit sunita
    wei mei jing hiroshi yuki kenji sakura minjun jiwoo linh minh anh kwame ama chinedu ngozi amara thabo kofi""".split()
)
_SURNAMES = """smith johnson brown taylor walker baker hill green cooper ward müller schmidt weber fischer dubois moreau lefèvre garcía fernández lópez silva pereira rossi bianchi
    jansen de-vries hansen lindqvist virtanen kowalski novák petrov ivanova shevchenko yılmaz demir haddad khalil sharma patel wang zhang tanaka suzuki nguyen tran okafor mensah dlamini o'connor mcgregor""".split()
_SYLLABLES = "ba bren cal den dor el fen gar hal is jor kel lan mor nar ol pen ran sel tor ul ven wick yar zan".split()
_ENDINGS = "berg dale ek er field in ley man mont ov ska son stad ton ura well wood".split()
TITLES = "Mr Mrs Ms Dr Prof Herr Frau Señora Monsieur".split()
_TRAILERS = "Signed-off Reviewed Co-authored Reported Tested Acked Suggested Helped".split()
_LABELS = ["SSN", "social security number", "national insurance number", "NHS number", "passport number", "passport", "tax ID", "tax number", "identity card", "ID card no.", "personal code", "driver's license", "driving licence no.", "DNI", "CPF", "PESEL", "Ausweisnummer", "Steuer-ID", "residence permit"]

#: {N} name, {E} mailbox, {P} phone, {A} address, {I} number of a person, {S} the same without label; the rest is filling.
FRAMES = """
{K}-by: {N} <{E}>
{K}-by: {N}
Cc: {N} <{E}>
Cc: {E}
Author: {N}
Maintainer: {N} <{E}>
Assignee = {N}
Regards,\\n{N}
Best wishes\\n{N}\\n{P}
Hi {N}, {w} {w} is {w}.
Dear {X} {N},
{X} {N} called about the {w}.
{X} {N} has a {w} that fails, see {A}.
{N} has approved this.
{N} said that the {w} is {w}
{N} writes: the {w} fails.
Asked {N} about it; no answer yet.
I talked to {N} about the {w}.
According to {N} the {w} is {w}.
as {N} told us, it breaks
spotted by {N}
found by {N} and {N}
Credit goes to {N} for the {w}.
thanks {N}!
Thanks to {N} and {N}.
My colleague {N} noticed it.
with {N} on {w} duty
Worked on this with {N} and {N}.
The {w} was written by {N}.
{N} will look at it next week.
{N}
- {N}
* {N} <{E}>
- {N} ({w})
1. {N}
{N} ({E})
{N}, {P}
{N} / {P} / {E}
{N}, {A}, {Z} {C}
{N}, born in {C}, {L} {I}
user {N} ({L}: {I})
user {N} cannot open the {w}
The customer {N} sees a blank {w}.
customer: {N}; address: {A}; phone: {P}
full_name: {N}
"name": "{N}", "mail": "{E}", "tel": "{P}"
owner="{N}" mail="{E}"
name={N}&street={A}&tel={P}
INSERT INTO users (name, mail) VALUES ('{N}', '{E}');
VALUES ({n}, '{N}', '{A}', '{P}')
| {N} | {E} | {P} |
{n},{N},{E},{Z}
<td>{N}</td><td>{A}</td>
<!-- ask {N} or {E} -->
{n}: {N}; {n}
Letter to {N} printed {A} twice.
The parcel for {N} went to {A} and not to {A}.
{N} lives at {A} and works in {C}.
My flat is at {A}; the {w} shows {C}.
Our office is at {A}, call {P}.
Office: {A}
address = {A}
Street: {A}
Ship it to {A}, {Z} {C}.
Nothing sent to {A} arrives.
The courier to {A} {w}s twice a day.
A {w} to {A} is late.
we met in front of {A} and left
She moved from {A} to {A}.
The {w} prints {A} wrongly.
{A}
{P}
{E}
call {P} or write to {E}
Phone: {P}
Tel {P}, fax {P}
mobile {P} is cut off
Ring me under {P} after {n}.
The {w} for {P} never arrives
to {P}: {w} sent
contact={P}
my number is {P}, my mail {E}
Send the {w} to {E}, please.
Send it to {E} and {E}.
From: {E}
mail {E} if it {w}
signed in as {E}
login {E} fails
{E} gets a {w}, {E} does not
send_mail("{E}")
email: {E}
mailto:{E}
My {L} is {I}.
{L}: {I}
{L} {I} does not pass the {w}
{w} accepts {L} {I} without a check
The {w} shows her {L} {I} to everyone.
row {n}: {S}; {N}
{S} was logged in clear text
Herr {N} hat angerufen, Telefon {P}.
Von {N} gemeldet, wohnhaft {A}.
Kundin {N} wohnt in {A}, {Z} {C}.
Rückfragen an {E} oder {P}
El usuario {N} ha llamado.
La clienta {N} vive en {A}.
Según {N} ({E}) es {w}.
D'après {N}, {A}, rien ne marche.
Le client {N} habite au {A}.
Merci à {N} pour son aide, tél. {P}
O usuário {N} mora em {A}.
Segundo {N}, {L} {I} é {w}.
The person to ask is {N}.
The only expert is {N}.
It was {N}.
The last one to see it was {N}
assigned to {N}
forwarded to {N}
The {w} is addressed to {N}
from {N}
Most of it comes from {N}.
{S}, {N}
{n}: {S}, {N}
{n}, {N}, {P}
{N} wrote {n} lines of it
Bitte an {N} wenden, {P}
Bitte {N} fragen
Kollege {N} ist unter {P} da.
The {w} of {N}, {A}, {Z} {C}, is {w}.
{A}, {Z} {C}, Telefon {P}
{A}, {Z} {C}, phone {P}
talk to me at {E} or {P}
handed over to {X} {N} at {n}
see {N}
{N} again
and {N}, too
{N}?
{N} helped a lot
now {N} {w}s the {w}
what about {N} and the {w}
({N})
""".strip().split("\n")
LOOKALIKES = """
The {D} {w} is {w}.
the {D} {w} and the {D} {w}
open {D} and press {w}
Open the {D} {w} first
{D} is {w}
{D} and {D} share a {w}.
## {D}
### {D} {D}
**{D}**
- {D}
- {D}: {w}
- {D} {w}
* {D} is {w}
{n}. {D}
{D}: {w} the {w}
Add {D}
Fix {D} {w}
Rename {D} to {D}
use {D} for the {w}
when {D} is on
With {D} it is {w}.
after {D} was {w}
by {D} only
ping the {D} team
@{w}-{w} please look at the {D} {w}
We deployed {D} to {C}.
in {C} the {w} is {w}
from {C} to {C}
The team in {C} is {w}.
{Z} {C}
deliver to {Z} {C}
Users near {C} see it.
Read {D} chapter {n}.
git clone git@{H}:{w}/{w}.git
git@{H}:{w}.git is {w}
ssh deploy@{H}:22
scp a.txt root@{H}:/tmp
{w}@{V} and @{w}/{w}@{V}
pin {w}@{V}
see https://{H}/{w}
looked at {H} today
met at {H} and left
build {n}-{n} took {n} ms
lines {n}-{n}
at 20{n} rows {F}
epoch {F} on 10.0.{n}.{n}
id {F}
order {F} is {w}
ticket number {F}
issue id {F} and build no. {n}
date 2019-0{d}-1{d} {n}:{n}
range {q} is {w}
{n} {W} {s} {w}s are {w}
see {n} {W} {s} {w} for it
{W} {n}
Diese {Y} ist {w}
Die {Y} der {Y} {w}
Neue {Y} für {Y} und {Y}
{Y}: {Y} {n}
Der {Y} {Y} zeigt die {Y}.
{C}, Telefon {n}
{C}, Tel {n}
see {D}
{D} again
and {D}, too
{D}?
{D} helped a lot
now {D} {w}s the {w}
what about {D} and the {w}
({D})
""".strip().split("\n")
_NOUNS = "Änderung Zeile Datei Anfrage Antwort Fehler Seite Übersicht Prüfung Liste Eingabe Ausgabe Meldung Verbindung Sitzung Abfrage Spalte Tabelle Einstellung Anmeldung".split()
_STREETS = "Street St Road Rd Avenue Lane Crescent Row Drive Court Close Place Terrace Square Gardens Way Park".split()


class Draw:
    """Items and filling, drawn at random; a document draws its persons once."""

    def __init__(self, words: Sequence[str], seed: int) -> None:
        self.words, self.rng = list(words), random.Random(seed)
        self.given = sorted(GIVEN)

    def digits(self, n: int) -> str:
        return "".join(self.rng.choice("0123456789") for _ in range(n))

    def stem(self) -> str:
        r = self.rng
        return "".join(r.choice(_SYLLABLES) for _ in range(r.choice([1, 2, 2]))) + r.choice(_ENDINGS)

    def person(self) -> dict[str, str]:
        r = self.rng
        cap = lambda w: re.sub(r"(^|['-])(\w)", lambda m: m[1] + m[2].upper(), w)
        first = r.choice(self.given) if r.random() < 0.6 else self.stem()
        u = r.random()
        last = r.choice(_SURNAMES).replace("de-vries", "vries") if u < 0.3 else r.choice(self.words) if u < 0.4 else self.stem()
        last = cap(f"{last}-{self.stem()}") if r.random() < 0.06 else cap(last)
        middle = f" {r.choice('ABCDEFGHJKLMPRSTW')}." if r.random() < 0.12 else ""
        of = r.choice(["van ", "von ", "de ", "van der ", "de la ", "al "]) if r.random() < 0.07 else ""
        extra = f" {cap(r.choice(self.given))}" if r.random() < 0.12 and not middle else ""
        name = f"{of}{last}, {cap(first)}{middle}" if r.random() < 0.12 else f"{cap(first)}{middle}{extra} {of}{last}"
        if of == "al ":
            name = name.replace("al ", "Al-", 1) if "," not in name else name.replace("al ", "")
        u = r.random()
        name = name.upper() if u < 0.06 else name.lower() if u < 0.14 else name
        plain = lambda w: re.sub(r"[^a-z]", "", w.lower()) or "x"
        f, n = plain(first), plain(last)
        local = r.choice([f"{f}.{n}", f"{f}_{n}", f"{n}.{f}", f"{f[0]}.{n}", f"{f[0]}{n}", f"{n}{self.digits(2)}", f"{f}-{n}", f"{f}.{n}+{r.choice(_SYLLABLES)}", f"{f}{n}"])
        host = f"{self.stem()}.{r.choice(['com', 'org', 'net', 'example', 'test', 'de', 'co.uk', 'io'])}"
        host = f"{r.choice(['mail', 'post', 'dept'])}.{host}" if r.random() < 0.3 else host
        at, dot = r.choice([("@", ".")] * 7 + [(" at ", " dot "), ("(at)", "."), (" [at] ", " [dot] "), (" (at) ", "."), (" AT ", " DOT ")])
        return {"N": name, "E": f"{local}{at}{host.replace('.', dot)}"}

    def town(self) -> str:
        return self.rng.choice(["", "", "Bad ", "Port ", "New ", "San ", "Saint ", "Upper "]) + self.stem().capitalize()

    def feature(self) -> str:
        r = self.rng
        first = r.choice(self.given) if r.random() < 0.2 else r.choice(self.words)
        return f"{first.capitalize()} {r.choice(self.words).capitalize()}" + (f" {r.choice(self.words).capitalize()}" if r.random() < 0.15 else "")

    def value(self, slot: str) -> str:
        r, d = self.rng, self.digits
        if slot == "P":
            return r.choice([f"+44 20 7{d(3)} {d(4)}", f"+44 7{d(3)} {d(6)}", f"+1 ({r.randint(201, 989)}) {d(3)}-{d(4)}", f"+1-{r.randint(201, 989)}-{d(3)}-{d(4)}", f"({r.randint(201, 989)}) {d(3)}-{d(4)}", f"{r.randint(201, 989)}-{r.randint(200, 999)}-{d(4)}", f"{r.randint(201, 989)}.{r.randint(200, 999)}.{d(4)}", f"+49 {d(3)} {d(6)}", f"+49 (0) {r.randint(30, 89)} {d(5)}", f"030/{d(5)}-{d(2)}", f"0{r.randint(30, 89)}1 {d(6)}", f"+33 {r.randint(1, 9)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0033 {r.randint(1, 9)} {d(2)} {d(2)} {d(2)} {d(2)}", f"+34 6{d(2)} {d(3)} {d(3)}", f"+351 21 {d(3)} {d(4)}", f"+61 4{d(2)} {d(3)} {d(3)}", f"0{r.randint(1200, 1990)} {d(6)}", f"+{r.randint(30, 98)}{d(9)}"])
        if slot == "A":
            n, x, w = r.randint(1, 260), self.stem().capitalize(), r.choice(self.words).capitalize()
            return r.choice([f"{n} {x} {r.choice(_STREETS)}", f"{n} {w} {r.choice(_STREETS)}", f"{n} {w} {r.choice(self.words).capitalize()} {r.choice(_STREETS)}", f"{n} {r.choice(['North', 'South', 'Old', 'Upper'])} {w} {r.choice(_STREETS)}", f"{n} {w} Rd.", f"{n} {x}'s {r.choice(_STREETS)}", f"{n} {w}'s {r.choice(_STREETS)}", f"{w}{r.choice(['straße', 'weg', 'gasse'])} {n}", f"{n} bis, rue des {w}", f"{n} rue des {w}", f"{n}{r.choice('abc')} {x} {r.choice(_STREETS)}", f"{n} {x} Rd.", f"{x}{r.choice(['straße', 'strasse', 'str.', 'weg', 'gasse', 'platz', 'allee'])} {n}", f"{n} rue de {x}", f"{n}, avenue du {x}", f"{n} bis, rue des {x}", f"{n} place {x}", f"Calle {x} {n}", f"Calle de {x}, {n}", f"Avenida de los {x} {n}", f"Rua {x}, {n}", f"Rua da {x} {n}", f"Via {x} {n}"])
        if slot == "I":
            return r.choice([f"{d(3)}-{d(2)}-{d(4)}", f"{d(2)} {d(3)} {d(3)} {d(2)}", f"{d(3)} {d(3)} {d(4)}", f"{d(9)}", f"{d(8)}{r.choice('ABKXZ')}", f"{r.choice('ABCX')}{d(8)}", f"{r.choice('ABC')}{r.choice('EHK')} {d(2)} {d(2)} {d(2)} {r.choice('ABCD')}", f"{d(3)}.{d(3)}.{d(3)}-{d(2)}", f"{d(6)}-{d(4)}", f"{d(2)}/{d(3)}/{d(5)}", f"{r.choice('LMN')}{d(2)}{r.choice('XYZ')}{d(6)}", f"{r.choice('ABCDE')}{r.choice('FGHIJ')}{r.choice('KLMNO')}{r.choice('PQRST')}{d(6)}{r.choice('AB')}{d(1)}"])
        simple = {
            "S": lambda: f"{r.randint(100, 999)}-{d(2)}-{d(4)}", "K": lambda: r.choice(_TRAILERS), "X": lambda: r.choice(TITLES) + ("." if r.random() < 0.4 else ""), "L": lambda: r.choice(_LABELS), "Z": lambda: d(5), "C": self.town,
            "D": self.feature, "W": lambda: r.choice(self.words).capitalize(), "Y": lambda: r.choice(_NOUNS), "w": lambda: r.choice(self.words), "n": lambda: str(r.randint(1, 999)), "d": lambda: r.choice("123456789"), "F": lambda: r.choice("123456789") + d(r.randint(6, 10)),
            "H": lambda: f"{self.stem()}.{r.choice(['example', 'org', 'net'])}", "V": lambda: f"{r.randint(0, 9)}.{r.randint(0, 30)}.{r.randint(0, 9)}", "q": lambda: f"{d(3)}.{d(3)}.{d(4)}", "s": lambda: r.choice(_STREETS),
        }
        return simple[slot]()

    def line(self, frame: str, persons: Sequence[dict[str, str]]) -> tuple[str, set[tuple[int, int]]]:
        """A filled frame and where its items stand."""
        text, gold, at = "", set(), 0
        turn = self.rng.randrange(len(persons))
        who = persons[turn]
        frame = frame.replace("\\n", "\n")
        for m in re.finditer(r"\{(\w)\}", frame):
            text += frame[at : m.start()]
            if m[1] == "N" and m.start() > frame.find("{N}"):
                turn += 1
                who = persons[turn % len(persons)]
            value = who[m[1]] if m[1] in "NE" else self.value(m[1])
            if m[1] in "NEPAIS":
                gold.add((len(text), len(text) + len(value)))
            text += value
            at = m.end()
        return text + frame[at:], gold

    def document(self, frames: Sequence[str], decoys: Sequence[str]) -> tuple[str, set[tuple[int, int]]]:
        """A few lines about one to three persons, who come up again in other frames; look-alikes do, too."""
        r, text, gold = self.rng, "", set()
        persons = [self.person() for _ in range(r.randint(1, 3))]
        again = self.feature()
        for _ in range(r.randint(1, 5)):
            if r.random() < 0.6:
                line, found = self.line(r.choice(frames), persons)
            else:
                frame = r.choice(decoys)
                line, found = self.line(frame.replace("{D}", again, 1) if r.random() < 0.4 else frame, persons)
            gold |= {(a + len(text), b + len(text)) for a, b in found}
            text += line + r.choice(["\n", "\n", "\n\n", "\r\n"])
        return text, gold
