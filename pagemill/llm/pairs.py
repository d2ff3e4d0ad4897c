"""Defective prompt and response pairs, each with its type of defect.

empty      one of the answer's fields says nothing at all: null, or no letter or digit
refusal    a sentence aligns with a refusal template (longest common subsequence of the template's tokens)
copy       the answer's shingles are contained in the question and their longest common subsequence covers most of it
language   script or function words are of another language than the question's; quoted titles are left out
truncated  a field ends before its statement does: behind its label, in the middle of the value that the other field
           gives in full, in a dangling word or an open quotation, or, without a full stop, in words with which no
           sentence of the corpus ends

The first that holds, in this order, is the row's defect. Only the last needs the corpus: the words at sentence ends
are counted once per worker and joined to the open ends by key.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.session import materialised, spread

TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
_LABEL = re.compile(r"\s*([^:\n]{1,80}):(.*)\Z", re.S)
_SAYS = re.compile(r"[^\W_]")

#: Refusals, as token sequences; "*" stands for any tokens between.
REFUSALS = """
i'm sorry but i can't help with that request
i am sorry but i cannot assist with that
sorry i can't help with that
sorry this falls outside what i am allowed to discuss
apologies but answering that would go against my policies
answering this would violate my guidelines
unfortunately i'm unable to assist
unfortunately i am not able to help with this
i am unable to answer this question
i'm not able to provide that information
i cannot provide information about *
i can't provide information on *
i cannot answer this question
i cannot assist with *
i cannot help with *
i can not comment on *
i won't answer this
i will not answer this
i won't provide *
i must decline to answer *
i have to decline *
i respectfully decline *
i would rather not respond to *
i would rather not answer *
i'd rather not discuss *
i prefer not to answer *
i am not allowed to discuss *
i'm not permitted to answer *
i am not comfortable answering *
i do not feel comfortable discussing *
it would not be appropriate for me to comment on *
it would be inappropriate for me to *
my guidelines prevent me from discussing *
my policies do not allow me to *
as an ai model i am not able to *
as an ai language model i cannot *
as an ai i can't *
this assistant does not give advice on *
this assistant cannot help with *
thank you for the question however i have to refuse
thanks for asking but i must refuse
i refuse to answer *
i have been instructed not to answer *
this request cannot be processed for safety reasons
for safety reasons i cannot *
that is something i can't discuss
"""
_TEMPLATES = [[t for t in line.split() if t != "*"] for line in REFUSALS.strip().splitlines()]
_CUES = tuple("sorry|apolog|unable|declin|refus|cannot|can't|can’t|can not|won't|won’t|will not|not able|guidelines|policy|policies|appropriate|rather not|prefer not|as an ai |assistant|not allowed|not permitted|comfortable|instructed".split("|"))

#: Function words by language.
FUNCTION_WORDS = {
    "en": "the of that is are was were this in for on with by to it not and as from be no which at an its has have given there or if about per",
    "de": "der die das und ist nicht mit von für den dem des ein eine einer wurde wurden bei nach im zu auf sich keine daher laut über als durch wird auch aus am",
    "fr": "le la les des du et est une un dans pour par sur aucun aucune que qui ne pas selon été était chez au aux avec ce cette sont a après l d n",
    "es": "el la los las de del y es una un en para por se que no con según al lo fue sin sobre como su durante más",
    "it": "il la gli le di del della e è un una per con che non secondo nel dei hanno senza sono da al alla ricevuto",
    "pt": "o a os as de do da dos e é um uma em para por com que não na no de acordo foi sem durante todo se ao",
    "nl": "de het een en van is niet op in voor met aan via werd wordt dat geen maar wel hierover volgens zijn er door bij",
    "pl": "i w na z do nie jest się o po a że ze zgodnie przez oraz dla od był była było",
    "sv": "och att det en ett som är på av för med till inte enligt den har från om vid gavs utan",
    "da": "og at det en et som er på af for med til ikke ifølge den har fra om ved blev uden",
    "fi": "ja on ei että se oli mukaan sekä kun joka ovat ole tai mutta",
    "cs": "a v na se je že z do podle po byl byla bylo nebo pro při s k",
    "hu": "a az és nem hogy egy is volt szerint meg el de vagy",
    "ro": "și de la în cu nu pe un o este sunt conform din care pentru fără",
    "tr": "ve bir bu ile için göre olarak da de olan değil",
}
#: Single letters are also signs of units ("w/w") and names, so they tell nothing.
_WORDS = {k: frozenset(w for w in v.split() if len(w) > 1) for k, v in FUNCTION_WORDS.items()}
_EN = _WORDS["en"]
_QUOTED = re.compile(r"[\"“„«][^\"“”„«»]*[\"”“»]|\([\"“„«][^)]*\)")
_QUOTE = re.compile("[\"„«“]")
_LATIN = re.compile(r"[A-Za-zÀ-ɏ]")
_OTHER_SCRIPT = re.compile(r"[^\W\d_A-Za-zªºµÀ-ʯΑ-Ωα-ω]")
_GREEK_RUN = re.compile(r"[Ͱ-Ͽἀ-῿]{3,}")


def tokens(text: str) -> list[str]:
    own = TOKEN.findall(text.lower())
    return [t.replace("’", "'") for t in own] if "’" in text else own


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, bit-parallel over a."""
    where: dict[str, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    row = mask = (1 << len(a)) - 1
    for y in b:
        m = row & where.get(y, 0)
        row = ((row + m) | (row - m)) & mask
    return len(a) - row.bit_count()


def is_empty(text: str | None) -> bool:
    """Nothing at all is said: no letter or digit."""
    return text is None or not _SAYS.search(text)


def is_bare_label(text: str) -> bool:
    """A formatted answer that stops behind its label."""
    return text.rstrip()[-1:] == ":" and text.count(":") == 1 and len(text) <= 80 and not re.search(r"[.!?]\s", text)


@lru_cache(maxsize=50_000)
def _refuses(sentence: str) -> bool:
    own = tokens(sentence)
    for t in _TEMPLATES:
        if len(own) >= len(t) - 1 and lcs(t, own) >= max(3, -(-len(t) * 85 // 100)):
            # a template's tokens stand together, apart from its open end: their span is nearly theirs
            first = own.index(t[0]) if t[0] in own else -1
            if first >= 0 and lcs(t, own[first : first + len(t) + 3]) >= max(3, -(-len(t) * 85 // 100)) and first <= 6:
                return True
    return False


_SENTENCE = re.compile(r"[^.!?\n]+[.!?]?")


def is_refusal(text: str) -> bool:
    """Whether any sentence that has a cue refuses."""
    low = text.lower()
    if not any(c in low for c in _CUES):
        return False
    return any(_refuses(s) for s in _SENTENCE.findall(text) if any(c in s.lower() for c in _CUES))


@lru_cache(maxsize=5000)
def _question(text: str) -> tuple[list[str], frozenset, frozenset]:
    t = tokens(text)
    return t, frozenset(t), frozenset(zip(t, t[1:], t[2:]))


_INTRO = frozenset("you asked question the is was asks my your user prompt q answer".split())


def is_copy(question: str | None, text: str, own: list[str] | None = None) -> bool:
    """Nothing but the question, or most of it, once or more, maybe behind an introduction ("You asked", "Let me respond:")."""
    if not question:
        return False
    if len(_question(question)[0]) < 4:
        return False
    head, colon, rest = text.partition(":")
    return _repeats(question, tokens(text) if own is None else own) or bool(colon) and len(tokens(head)) <= 12 and _repeats(question, tokens(rest))


def _repeats(question: str, a: list[str]) -> bool:
    q, words, shingles = _question(question)
    at = 0
    while at < min(3, len(a)) and a[at] in _INTRO and a[at] != q[0]:
        at += 1
    a = a[at:]
    if len(a) * 2 < len(q) or sum(x in words for x in a) < 0.9 * len(a):
        return False
    own = list(zip(a, a[1:], a[2:]))
    if not own or sum(s in shingles for s in own) < 0.75 * len(own):
        return False
    # most of the question, in its order; what is left of the answer is more of it
    return lcs(q, a) * 2 >= len(q) and (len(a) <= 1.15 * len(q) or lcs(q, a[len(q) :]) >= 0.8 * min(len(q), len(a) - len(q)))


def _language(text: str, own: list[str] | None = None) -> str | None:
    """Language by function words, '?' for another script; None where nothing tells."""
    if not text.isascii():
        other = len(_OTHER_SCRIPT.findall(text)) + sum(map(len, _GREEK_RUN.findall(text)))
        if other and other * 4 >= other + len(_LATIN.findall(text)):
            return "?"
    own = tokens(text) if own is None else own
    hits = sum(map(_EN.__contains__, own))
    if hits * 5 >= len(own):
        return "en" if hits else None
    distinct = set(own)
    best, most = "en", len(distinct & _EN)
    for k, ws in _WORDS.items():
        if (n := len(distinct & ws)) > most:
            best, most = k, n
    return best if most >= 2 else None


@lru_cache(maxsize=5000)
def _question_language(text: str) -> str | None:
    return _language(text)


def is_foreign(question: str | None, text: str, own: list[str] | None = None) -> bool:
    """In another language than the question (English where there is no question); quoted titles are left out."""
    asked = (_question_language(question) if question else None) or "en"
    spoken = _language(_QUOTED.sub(" ", text)) if _QUOTE.search(text) else _language(text, own)
    return spoken is not None and spoken != asked


#: What a formatted value may be followed by: remarks in brackets, groups and vehicles.
_SUFFIX = re.compile(r"(?:\s*\([^()]*\)|\s+(?:for|in|with)\s+[a-z]+(?:\s+[a-z]+)?)+\s*\Z", re.I)
_DANGLING = re.compile(r"(?:^|[\s(])(?:and|or|the|of|in|with|by|to|for|a|an|at|on|from|per|that|than|as|was|were|is|are|be|about|approx\.?|ca\.|up to|[>≥<≤~])\s*\Z", re.I)
_ENDED = re.compile(r"[.!?…。！？][\"'”’)\]»]*\s*\Z")
_SPLIT = re.compile(r"(?<=[.!?])[\"”]?\s+|\n+")
_NUMBER = re.compile(r"\d+(?:[.,]\d+)*")
_NAME = re.compile(r"\A[A-Z][a-zà-ÿ]{5,}\Z")


_PROPER = re.compile(r"\s*(?:null(?:\s*:\s*null)?|not applicable)\.?\Z", re.I)


def value_of(corrected: str | None) -> str:
    """What stands behind the label of a formatted answer, without remarks on groups or vehicles."""
    m = _LABEL.match(corrected or "")
    if not m:
        return ""
    v = _SUFFIX.sub("", m[2].strip())
    return "" if v.lower() == "null" else v


def end_key(sentence: str) -> str:
    """The last three words of a sentence, with numbers and names masked."""
    last = sentence.rstrip().rstrip(".!?…\"'”’»").rsplit(None, 3)[-3:]
    return " ".join("S" if _NAME.match(w.strip(",;:()")) else _NUMBER.sub("9", w) for w in last)


def open_end(output: str, corrected: str | None) -> str | bool:
    """True: output is truncated; False: it is not; a key: it is, unless a sentence of the corpus ends so."""
    text = output.rstrip()
    if _PROPER.match(text):
        return False
    v = value_of(corrected)
    if v and not text.endswith(v):
        if v not in text:
            # it ends in the middle of the value
            for n in range(min(len(v) - 1, len(text)), 0, -1):
                if text.endswith(v[:n]) and (n == len(text) or text[-n - 1] in " \n\t"):
                    return True
    elif v:
        return False
    if text.count('"') % 2:
        return True
    if _ENDED.search(text):
        return False
    if _DANGLING.search(text):
        return True
    return end_key(_SPLIT.split(text)[-1])


@lru_cache(maxsize=200_000)
def _corrected(question: str | None, text: str | None) -> str | None:
    """Defect of the formatted answer, which often recurs."""
    if is_empty(text):
        return "empty"
    if is_refusal(text):
        return "refusal"
    if is_copy(question, text):
        return "copy"
    if is_foreign(question, text):
        return "language"
    return "truncated" if is_bare_label(text) or _DANGLING.search(text) and not _ENDED.search(text) else None


def defect(question: str | None, output: str | None, corrected: str | None) -> tuple[str | None, str | None]:
    """(defect, None), (None, key of an open end) or (None, None)."""
    c = _corrected(question, corrected)
    if c == "empty" or is_empty(output):
        return "empty", None
    if c == "refusal" or is_refusal(output):
        return "refusal", None
    own = tokens(output)
    if c == "copy" or is_copy(question, output, own):
        return "copy", None
    if c == "language" or is_foreign(question, output, own):
        return "language", None
    if c == "truncated":
        return c, None
    got = open_end(output, corrected)
    return (None, got) if isinstance(got, str) else ("truncated" if got else None, None)


def _examine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """state_id with its defect or its open end; and, without state_id, the ends of whole sentences."""
    ends: set[str] = set()
    tails: set[str] = set()
    for b in batches:
        ids, found, keys = [], [], []
        new: set[str] = set()
        for i, q, o, c in zip(*(col.to_pylist() for col in b.columns)):
            d, key = defect(q, o, c)
            if d or key:
                ids.append(i)
                found.append(d)
                keys.append(key)
            if not d and o:
                for s in _SPLIT.split(o):
                    if s and s[-1] in ".!?" and (tail := s[-48:]) not in tails:
                        # equal last 48 characters have equal last words, if these are all within them
                        if tail.count(" ") >= 3 and len(tails) < 300_000:
                            tails.add(tail)
                        new.add(end_key(s))
        new -= ends
        if len(ends) < 1_000_000:  # only spares repeats; what is beyond is sent again
            ends |= new
        keys += new
        yield pa.RecordBatch.from_arrays([pa.array(ids + [None] * len(new), b.column(0).type), pa.array(found + [None] * len(new), pa.string()), pa.array(keys, pa.string())], names=["state_id", "defect", "key"])


def found_defects(run_states: DataFrame) -> DataFrame:
    """state_id, defect: one row for each defective row of run_states.

    A null question is taken as an English one without words to copy; null, empty and blank answers are "empty".
    """
    kind = run_states.schema["state_id"].dataType.simpleString()
    seen = materialised(spread(run_states.select("state_id", "question", "output", "corrected_output")).mapInArrow(_examine, f"state_id {kind}, defect string, key string"))
    whole = seen.where("state_id is null").select("key").distinct()
    sure = seen.where("state_id is not null and defect is not null").select("state_id", "defect")
    cut = seen.where("state_id is not null and defect is null").join(whole, "key", "left_anti").select("state_id", F.lit("truncated").alias("defect"))
    return sure.unionByName(cut)
