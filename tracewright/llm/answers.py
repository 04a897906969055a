r"""Defective answers to requests: empty, refusal, copied, other_language, truncated.

Copies: the answer is compressed with its request as a zstandard dictionary; an answer that shrinks to nearly
nothing repeats stretches of the request and is a copy, unless it has a word that the request lacks. Refusals
and languages come from dictionaries: a sentence declines if it holds a word of inability together with its
speaker and the task, or an apology. Whether an answer without an end mark stops early is decided by a
terminal-context model: a logistic model of whether a sentence can end where it ends, from its last words, its
opening and the distance to the last comma and conjunction. It is fitted on sentences of the answers
themselves; whole sentences against their own beginnings.

The model is fitted on the answers of at most SAMPLE_ROWS keys (those of least hash); everything else
covers all rows. Order of defects where several hold: as in the first line. All tests take time in
proportion to the text.

Defined cases: a null or blank answer is empty; a null or empty array of summaries is no case; a null
request leaves only the defects that need none; repeated rows count once; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.common import bounded_sample
from tracewright.session import spread, table

SAMPLE_ROWS, DIMS = 6000, 1 << 17
#: Bytes of a zstandard frame with one repeat in it, and further bytes per byte up to which an answer repeats its request.
FRAME, REPEATS = 12, 0.25

#: Frequent words of the languages met in requests and answers.
STOPWORDS = {
    "en": "the and a an of to in is it that with for on this by be which each any so also now used without through both when if we not before after from are or as every own".split(),
    "de": "der die das und ist nicht mit für auf ein eine wird den dem des zu im bei nach weil ohne wieder mehr jetzt auch von sich wie nur diese dieser keine alle wurde aus".split(),
    "es": "el la los las y es no con para en un una de del por que se al ya cada porque sin más ahora este esta otra vez después todas sobre como lo su".split(),
    "fr": "le la les et est ne pas avec pour dans un une de des du au aux que qui ce cette plus chaque car sans maintenant après tous sur comme à son l d".split(),
    "pt": "a o os as e é não com para em um uma de do da dos das no na por que se já cada porque sem mais agora este esta outra depois todas como seu à sua".split(),
    "pl": "i w na z nie się do jest to że dla po przy bo bez już od każdym wszystkich ta ten teraz znów pod przez jak o".split(),
    "it": "il lo la gli le e è non con per in un una di del della che si al ogni perché senza più ora questo questa dopo tutti come da".split(),
    "sv": "och att det är en ett som inte på av för med till den har kan om när från eller nu också utan alla varje".split(),
    "da": "og at det er en et som ikke på af for med til den har kan om når fra eller nu også uden alle hver".split(),
    "cs": "a v na se je že do pro při by bez už od každý všech ta ten teď znovu pod přes jak když nebo jsou již aby".split(),
    "tr": "ve bir bu için ile de da değil daha her olarak ama sonra önce şimdi gibi kadar olan tüm veya".split(),
    "fi": "ja on ei että se kun myös tai jos nyt joka kuin mutta ennen jälkeen kaikki ilman niin ovat".split(),
    "hu": "a az és nem hogy egy is meg már csak mint de ha vagy minden most után előtt nélkül".split(),
    "ro": "și în la nu este un o de cu pentru că din pe mai sau dacă acum după fără toate".split(),
    "nl": "de het een en is niet met voor op van te dat bij na omdat zonder weer meer nu ook deze geen alle aan door".split(),
}
_STOP = {w: [x for x, ws in STOPWORDS.items() if w in ws] for ws in STOPWORDS.values() for w in ws}

_MARKS = {"pl": re.compile("[ąęłśżźćń]"), "sv": re.compile("[åä]"), "cs": re.compile("[ěřůčť]"), "tr": re.compile("[ışğ]"), "ro": re.compile("[țșă]"), "hu": re.compile("[őű]"), "pt": re.compile("[ãõ]"), "es": re.compile("[ñ¿¡]"), "de": re.compile("[ßäöü]"), "fr": re.compile("[èêœù]")}
_FILLER = re.compile(
    r"<!--.*?-->|\[?\b(?:no (?:description|summary|answer|content|text|comment|response)|n/?a|tbd|tba|todo|none|null|nil|undefined|empty|nan|pending|placeholder|lorem ipsum|fixme|wip|to be (?:done|added|written|determined))\b\]?"
    r"|^[ \t]{0,3}#{1,6} [^\n]*$|^\s*(?:description|summary|key changes|linked issues|answer)\s*:?\s*$|</?(?:p|br|hr|div|span|ul|ol|li|b|i|em|strong)\s*/?>|\bnbsp\b",
    re.I | re.M | re.S,
)
_LETTER = re.compile(r"[^\W_]")
#: The refusal dictionary: words of regret, of inability, of who speaks, and of the task; then requests for input and offers.
_REGRET = re.compile(
    r"\b(?:sorry|apolog(?:y|ies|i[sz]e)|i regret|unfortunately|regrettably|afraid|leider|tut mir leid|entschuldigung|lo siento|lamentablemente|lamento|désolée?|malheureusement|desculpe|sinto muito|infelizmente|mi dispiace|purtroppo|niestety|przepraszam|helaas|tyvärr|bohužel|maalesef|üzgünüm)\b", re.I
)
_UNABLE = re.compile(
    r"\b(?:can(?:not|['’]?t| not)|could(?: not|n['’]t)|un(?:able|willing)|not (?:able|possible|permitted|allowed|comfortable|authori[sz]ed|enough)|won['’]t|will not|impossible|declin\w+|refus\w+|(?:rather|prefer) not(?: to)?|do(?:es)?(?: not|n['’]t) (?:have|feel|see|allow|permit|let)|but not (?:with|for|on)|lack|insufficient|no access|blocked|withheld|filtered|prohibit\w*|forbid\w*|against|prevents? me|skip(?:ping|ped)?|nothing (?:to|i can)|outside(?: of)?|beyond"
    r"|no (?:summary|description|answer|text|response|content)(?= (?:can|could) be|:| is possible))\b",
    re.I,
)
_UNABLE_OWN = re.compile(r"\b(?:kann ich|ich kann|no puedo|no es posible|je ne peux pas|não (?:posso|consigo)|non posso|nie mogę|kan ik|jag kan inte|nemohu|yapamam|edemem)\b", re.I)
_SPEAKER = re.compile(r"\b(?:i|i['’](?:m|ve|d|ll)|me|my|our|(?:happy|glad) to|(?:not enough|insufficient) (?:information|context|details?)|as an? (?:ai|assistant|(?:large )?language model)|(?:the|this) (?:assistant|model|system|request|response|answer|one)|(?:content|safety|usage) (?:policy|policies|filter)|guidelines|policy|policies|error|refusal|refused|no (?:summary|description|answer|text|response|content))\b", re.I)
_BARE = re.compile(r"\W*(?:unable|cannot|can['’]?t|could not|not able|not possible|impossible|insufficient|not enough)\b", re.I)
_SELF = re.compile(r"\bas an? (?:ai|(?:large )?language model|assistant)\b", re.I)
_TASK = re.compile(
    r"\b(?:help\w*|assist\w*|writ\w+|summari[sz]\w+|summary|descri\w+|compl[yi]\w*|complet\w+|provid\w+|produc\w+|answer\w*|process\w*|generat\w+|access|tasks?|requests?|requested|content|context|information|input|diff|patch|this one|fulfil\w*|text|response|hacer|ayudar\w*|describir\w*|resumir\w*|escribir|procesar|helfen|beschreiben|zusammenfass\w+|aider|décrire|résumer|écrire|traiter|ajudar|descrever|escrever|processar|aiutar\w*|descrivere|riassumere)\b", re.I
)
_ASK = re.compile(r"\b(?:please|could you|can you|would you)\b(?:\W+\w+){0,2}?\W+(?:share|provide|paste|send|attach)\b", re.I)
_OFFER = re.compile(r"\b(?:happy|glad) to\b|\blet me know\b|\bfeel free\b|\bplease (?:try|contact)\b", re.I)
_SENTENCE = re.compile(r"(?<=[.!?。！？])\s+|(?<=[。！？])|\n+")
_LEAD = re.compile(r"^\s*(?:#{1,6}\s+|>\s?|[-*+•]\s+|\d+[.)]\s+)+")
_FENCE = re.compile(r"^\s*(?:```|~~~)", re.M)
_TOKEN = re.compile(r"`[^`\n]*`?|[^\W\d_]+(?:['’][^\W\d_]+)?|\d[\d.,]*|[,;:()\"]")


def plain(text: str) -> str:
    """The prose of an answer: code, headings, quote and list marks left out."""
    parts = re.split(r"(?ms)^\s*(?:```|~~~).*?(?:^\s*(?:```|~~~)\s*$|\Z)", text)
    lines = [x for p in parts for x in p.split("\n") if not re.match(r"\s{0,3}#{1,6}\s", x)]
    return "\n".join(_LEAD.sub("", x) for x in lines)


def is_empty(text: str | None) -> bool:
    return text is None or not _LETTER.search(_FILLER.sub(" ", re.sub(r"(?m)^\s*(?:```|~~~)\w*\s*$", " ", text)))


def _json_text(text: str) -> str:
    """The strings of a JSON object, a line each, those of an error marked as such; the text itself if it isn't JSON."""

    def strings(x: object, key: str = "") -> list[str]:
        if isinstance(x, str):
            return [f"error: {x}" if key.lower() in ("error", "refusal", "reason") else x]
        pairs = x.items() if isinstance(x, dict) else ((key, y) for y in x) if isinstance(x, list) else ()
        return [s for k, y in pairs for s in strings(y, k)]

    try:
        return "\n".join(strings(json.loads(text)))
    except (ValueError, RecursionError):
        return text


#: A stem of each entry of the dictionary: a text without any of them can't decline, which spares the search.
_STEMS = (
    "sorry apolog regret unfortun afraid leider leid entschuld siento lament désol malheur desculp sinto infeliz dispiace purtroppo niestety przeprasz helaas tyvärr bohužel maalesef üzgün"
    " not n't n’t cant unab unwill imposs declin refus rather prefer lack insuff access block withheld filter prohib forbid against prevent skip nothing outside beyond"
    " puedo posible peux posso consigo mogę kann kan nemohu yapamam edemem language assistant please could would"
).split() + ["no summary", "no description", "no answer", "no text", "no response", "no content", "as an ai", "can you"]


def _declines(sentence: str) -> bool:
    regret, own = _REGRET.search(sentence), _UNABLE_OWN.search(sentence)
    unable = own or _UNABLE.search(sentence)
    if regret or own:
        return bool(unable) or len(sentence.split()) <= 4
    if unable and (_SPEAKER.search(sentence) or _BARE.match(sentence)) and (_TASK.search(sentence) or len(sentence.split()) <= 4):
        return True
    return _SELF.search(sentence) is not None or (_ASK.search(sentence) is not None and _TASK.search(sentence) is not None) or len(sentence.split()) <= 2 and unable is not None


def is_refusal(text: str) -> bool:
    """At least half of the sentences, those apart that only offer help, decline the task."""
    if text.lstrip()[:1] == "{":
        text = _json_text(text)
    low = text.lower()
    if not any(stem in low for stem in _STEMS):
        return False
    said = [x for s in _SENTENCE.split(plain(text).strip()) if (x := s.strip()) and _LETTER.search(x)]
    declined = [_declines(s) for s in said]
    told = sum(1 for s, d in zip(said, declined) if d or not _OFFER.search(s))
    return sum(declined) * 2 >= told and any(declined)


def language(text: str) -> str | None:
    """The language with most frequent words; None where nothing tells it."""
    letters = _LETTER.findall(text)
    if not letters:
        return None
    wide = "" if text.isascii() else "".join(c for c in text if c > "\u036f")
    for code, script in () if not wide else (("ja", "[぀-ヿ]"), ("ko", "[가-힯]"), ("zh", "[一-鿿]"), ("ru", "[Ѐ-ӿ]"), ("ar", "[؀-ۿ]"), ("el", "[Ͱ-Ͽ]")):
        if len(re.findall(script, wide)) > (0.1 if code == "ja" else 0.3) * len(letters):
            return code
    hits: Counter = Counter(x for w in re.findall(r"[^\W\d_]+", text.lower()) for x in _STOP.get(w, ()))
    for code, marks in () if text.isascii() else _MARKS.items():
        if marks.search(text):
            hits[code] += 1
    ranked = hits.most_common(2)
    if not ranked or ranked[0][1] < 2 or len(ranked) > 1 and ranked[0][1] == ranked[1][1]:
        return None
    return ranked[0][0]


def _words(text: str) -> list[str]:
    return re.findall(r"\w+", text.lower())


def _bare(text: str) -> str:
    """An answer without marks of restyling: case, quotes, bullets, headings, a label in front."""
    text = re.sub(r"(?i)^\W*(?:description|summary|answer|response|title|changes?)\s*:\s*", "", text.strip())
    lines = [_LEAD.sub("", x) for x in text.split("\n") if not re.match(r"\s{0,3}#{1,6}\s", x)]
    return " ".join(_words(" ".join(lines)))


class Copies:
    """One request as a dictionary for its answers."""

    def __init__(self, request: str) -> None:
        words = _words(request)
        self.words = frozenset(words)
        self.packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict((" ".join(words) + " ").encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)

    def share(self, bare: str) -> float:
        """Compressed bytes per byte of an answer."""
        raw = bare.encode("utf-8", "replace")
        return max(0, len(self.packer.compress(raw)) - FRAME) / len(raw)

    def made_of(self, answer: str) -> bool:
        """The answer repeats the request: it costs next to nothing beside it. An exact check follows: no word is new."""
        bare = _bare(answer)
        return bare.count(" ") >= 1 and self.share(bare) <= REPEATS and self.words.issuperset(bare.split(" "))


#: Joining words of English; which of them a sentence holds tells what it still lacks.
JOINING = (",", "and", "or", "but", "so", "because", "since", "if", "when", "while", "before", "after", "until", "unless", "which", "that", "where", "both", "either", "without", "through", "than")


@dataclass
class TerminalModel:
    """Whether a sentence can end after the given tokens."""

    weights: np.ndarray
    known: frozenset

    def tokens(self, sentence: str) -> list[str]:
        out = []
        for t in _TOKEN.findall(sentence):
            t = "<code>" if t[0] == "`" else "<0>" if t[0].isdigit() else t.lower()
            out.append(t if t in self.known or t in ("<code>", "<0>") else "<rare>")
        return out

    @staticmethod
    def features(t: list[str]) -> list[int]:
        n = len(t)
        w = [t[n - 1 - k] if k < n else "<s>" for k in range(5)]
        back = t[::-1]
        comma = min(back.index(","), 14) if "," in back else -1
        joined = next((min(k, 9) for k, x in enumerate(back) if x in ("and", "und", "y", "et", "e", "or")), -1)
        head = " ".join(t[:1])
        body = [x for x in JOINING if x in t]
        raw = [f"0{w[0]}", f"1{w[1]}", f"2{w[2]}", f"3{w[3]}", f"01{w[1]} {w[0]}", f"12{w[2]} {w[1]}", f"123{w[3]} {w[2]} {w[1]}", f"13{w[3]} {w[1]}", f"h1{head} {w[1]}", f"h2{head} {w[2]} {w[1]}", f"n{min(n, 30)}", f"hn{head} {min(n, 30)}", f"c{comma} {joined}", f"hc{head} {comma} {joined}", f"c1{comma} {w[1]}", f"j1{joined} {w[1]} {w[2]}", f"b{head} {' '.join(body)}", f"b1{' '.join(body)} {w[1]}", "bias"]
        return [zlib.crc32(x.encode()) & (DIMS - 1) for x in raw]

    def ends(self, sentence: str) -> bool:
        t = self.tokens(sentence)
        return bool(t) and float(self.weights[self.features(t)].sum()) >= 0


def fit_terminal_model(answers: list[str], seed: int = 7, epochs: int = 6) -> TerminalModel:
    """Whole sentences against proper beginnings of them, some cut inside a word."""
    whole = []
    for a in answers:
        for line in plain(a).split("\n"):
            parts = [p.strip() for p in re.split(r"(?<=[.!?])\s+", line)]
            whole += [p.rstrip(".!? ") for p in parts if p and p[-1] in ".!?" and len(p.split()) > 2]
    counts = Counter(t.lower() for s in whole for t in _TOKEN.findall(s))
    model = TerminalModel(np.zeros(DIMS), frozenset(t for t, n in counts.items() if n >= 2))
    rng = np.random.default_rng(seed)
    rows, labels = [], []
    for s in whole:
        t = model.tokens(s)
        if not t:
            continue
        rows.append(model.features(t))
        labels.append(1.0)
        for cut in {int(x) for x in rng.integers(1, max(2, len(t)), 3)}:
            part = t[:cut]
            if cut < len(t):
                if rng.random() < 0.25:
                    part = [*part[:-1], "<rare>"]
                rows.append(model.features(part))
                labels.append(0.0)
    if not rows:
        return model
    x, y = np.array(rows), np.array(labels)
    weights, seen = np.zeros(DIMS), np.full(DIMS, 1e-6)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(order), 256):
            some = order[at : at + 256]
            p = 1 / (1 + np.exp(-np.clip(weights[x[some]].sum(1), -30, 30)))
            step = np.zeros(DIMS)
            np.add.at(step, x[some], np.repeat(((p - y[some]) / len(some))[:, None], x.shape[1], 1))
            at_ = np.flatnonzero(step)
            seen[at_] += step[at_] ** 2
            weights[at_] -= 0.3 * step[at_] / np.sqrt(seen[at_])
    model.weights = weights
    return model


_REFERENCE = re.compile(r"(?i)^(?:(?:closes|fixes|resolves|relates to|refs?|see|part of)?[\s:]*(?:[\w./-]*#\d+|https?://\S+)[,\s]*(?:and\s*)?)+$")


def is_truncated(text: str, model: TerminalModel) -> bool:
    """It stops inside code, behind an empty list mark or a joining mark, or where no sentence ends."""
    if len(_FENCE.findall(text)) % 2:
        return True
    last = text.rstrip().split("\n")[-1]
    if _FENCE.match(last):
        return False
    if re.fullmatch(r"\s*(?:[-*+•]|\d+[.)])", last):
        return True
    if re.match(r"\s{0,3}#{1,6}\s", last):
        return False
    sentence = re.split(r"(?<=[.!?。！？])\s+", _LEAD.sub("", last).strip())[-1].strip()
    if not sentence or _REFERENCE.match(sentence) or sentence.lower() in ("none", "n/a", "nothing"):
        return False
    if sentence[-1] in ",;:([{-–—&/" or sentence.endswith(("...", "…")):
        return True
    if sentence.count("`") % 2 or sentence.count("(") > sentence.count(")") or sentence.count('"') % 2:
        return True
    if sentence[-1] in ".!?。！？)`\"'»”]}|>*_":
        return False
    return not model.ends(sentence)


def defect_of(answer: str | None, copies: Copies | None, wanted: str | None, model: TerminalModel) -> str | None:
    if is_empty(answer):
        return "empty"
    if is_refusal(answer):
        return "refusal"
    if copies is not None and copies.made_of(answer):
        return "copied"
    if wanted is not None and (found := language(plain(answer))) is not None and found != wanted:
        return "other_language"
    return "truncated" if is_truncated(answer, model) else None


def request_language(prompt: str) -> str | None:
    """Of its opening line, which gives the task; else of the whole request."""
    return language(prompt.strip().split("\n")[0]) or language(prompt)


def find_defects(rows: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(generation_id, filename, defect) of unusable answers; one narrow pass after the fit."""
    kept = rows.select("generation_id", "prompt", "description", "file_summaries")
    texts = kept.select("generation_id", "description", F.transform("file_summaries", lambda x: x["summary"]).alias("parts"))
    sample = bounded_sample(texts, "generation_id", sample_rows).select("description", "parts")
    answers = sorted({a for d, parts in sample.collect() for a in (d, *(parts or [])) if a})
    sent = rows.sparkSession.sparkContext.broadcast(fit_terminal_model(answers))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = sent.value
        for batch in batches:
            found = []
            for key, prompt, text, parts in batch.itertuples(index=False, name=None):
                copies = Copies(prompt) if prompt and prompt.strip() else None
                wanted = request_language(prompt) if prompt else None
                each = [("", text)] + ([(p["filename"] or "", p["summary"]) for p in parts if p is not None] if parts is not None else [])
                found += [(key, name, d) for name, a in each if (d := defect_of(a, copies, wanted, model))]
            yield pd.DataFrame(found, columns=["generation_id", "filename", "defect"])

    return spread(kept, "generation_id").mapInPandas(judge, "generation_id long, filename string, defect string").distinct()


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unusable answers with the type of their defect."""
    return find_defects(table(spark, sf_dir, "generations"))
