"""Abusive, hateful and sexual passages by weak supervision.

Sentences are freed from disguise (wide forms, accents, look-alike and zero-width characters, digits and signs for
letters, stars, drawn-out and spaced letters). Lexicon and pattern voters each vote for one side or abstain. A
generative label model has, for both classes, each voter's rate and the correlations of the pairs of voters that are
most correlated given the class, as a log-linear model over all patterns of votes; it is estimated by expectation
maximisation over the counts of vote patterns (2^voters at most, whatever the corpus) and gives each pattern a
posterior. A linear classifier over words, word pairs and votes is trained on posteriors and the labelled samples, so
that it also knows the language that voters lack. A document's score is that of its worst sentence.

The corpus is read twice: once for the counts and a sample of each pattern by hash, once for the scores.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.session import materialised, spread

# ---------------------------------------------------------------------------------------------- disguise

_INVISIBLE = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x200E, 0x200F, 0x2060, 0xFEFF, 0x180E])
_ALIKE = str.maketrans("аесорхуіјѕкмнтвԁгɡαοερνικτ", "aecopxyijskmhtbdrgaoepvikt")
_LEET = str.maketrans("@$0134579€!|+", "asoieastgeilt")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_][ .\-_·]){2,}[^\W\d_](?![^\W_])")
_RUN = re.compile(r"(.)\1{2,}")
_DOUBLE = re.compile(r"(.)\1+")
_SENTENCE = re.compile(r"(?:(?<=[.!?…。])[\"'”’)\]]*|(?<=[:;]-[)(])|(?<=[\U0001F300-\U0001FAFF]))\s+|\n+")
_TOKEN = re.compile(r"[^\s,;:\"“”„«»()\[\]{}?/\\]+")
_MASKED = re.compile(r"\A[a-z]*\*+[a-z*]*\Z")


class _Plain(dict):
    """A table for str.translate, made as characters come: lower case, without accents and what can't be seen."""

    def __missing__(self, c: int) -> str:
        own = "" if c in _INVISIBLE else "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x)).lower()
        self[c] = own
        return own


_TO_PLAIN = _Plain()
_BASIC = re.compile(r"[a-z]")


def plain(text: str) -> str:
    """Lower case without accents, invisible and look-alike characters."""
    if not text.isascii():
        text = text.translate(_TO_PLAIN)
        return text.translate(_ALIKE) if _BASIC.search(text) else text
    return text.lower()


def single(word: str) -> str:
    """The word with runs of a letter as one: the key under which drawn-out words are looked up."""
    return _DOUBLE.sub(r"\1", word)


# ---------------------------------------------------------------------------------------------- lexicons

LEXICONS = {
    "insult": """moron idiot imbecile cretin scumbag dirtbag dumbass jackass nitwit dimwit halfwit blockhead lowlife
        asshole arsehole dipshit shithead bullshitter fuckwit fucker motherfucker fucking fuck cunt twat wanker
        dickhead douchebag whore slut skank tosser bellend numbskull simpleton dullard dunce buffoon airhead
        lunkhead knucklehead dolt ignoramus brainless spineless gutless pathetic arse shit bullshit
        faggot nigger kike tranny dumbfuck goddamn scoundrel wretch lardass fatass dumbo pinhead sissy""",
    "insult_weak": """swine creep loser bastard bitch degenerate retard prick piss pissed damn dumb stupid fool clown filthy
        rotten vile disgusting miserable useless worthless lying liar subhuman worm worms maggots ape apes monkey monkeys
        coward nasty ugly trash scum vermin garbage filth parasites cockroaches plague rubbish donkey donkeys dumbell""",
    "foreign": """vollidiot trottel arschloch dummkopf drecksau schlampe hurensohn wichser depp versager penner mistkerl
        miststuck abschaum ungeziefer maul schmarotzer untermensch untermenschen gesindel fotze verpiss scheisse scheiss
        dreckschwein drecksack volltrottel missgeburt fresse erbarmlich erbarmlicher erbarmliche dummes dumme dummer
        connard connasse salaud salope minable abruti abrutie ordure encule enculee merde gueule racaille
        debile batard petasse bouffon couillon putain pute clochard
        idiota imbecil inutil mierda maldito maldita estupido estupida gilipollas cabron cabrona puta puto escoria
        pendejo maricon zorra cretino asqueroso asquerosa subnormal desgraciado capullo pringado infierno alimanas
        coglione stronzo stronza vaffanculo klootzak""",
    "foreign_weak": """schwein schweine sau dreck mull ratten parasiten pauvre vermine cochon cochonne
        basura ratas guarra sucio sucia parasitos cerdo cerdos plaga cucarachas eliminer echarlos ausrotten vergasen""",
    "sexual": """porn porno pornographic slutty horny kinky lustful sexy tits boobs pussy blowjob handjob cumshot
        masturbate masturbating milf threesome nudes striptease stripper ass crotch moaned moaning hentai bdsm dildo
        titten geil geile geiler ficken fick muschi nutte bumsen nichons tetas follar polla desnuda desnudas""",
    "sexual_weak": """nude naked naughty nipple nipples breast breasts thigh thighs cam hot sex sexual touch bare uncensored
        lick licking undress undressed orgasm fetish hooker escort
        nackt nackte nackten schwanz bruste seins nus nue nues coquine caliente calientes desnudo pechos""",
}
#: What members of a people are called to degrade them.
DEGRADING = frozenset("""vermin scum filth garbage trash animal animals parasite parasites cockroach cockroaches plague subhuman
    subhumans rats pigs dogs apes monkeys maggots worms disease waste rubbish thieves criminals ungeziefer abschaum dreck
    parasiten ratten schweine tiere untermenschen schmarotzer gesindel pack vermine ordures ordure racaille cafards rats
    animaux parasites basura escoria alimanas cucarachas ratas parasitos animales plaga cerdos""".split())
_WORDS = {k: frozenset(w for w in v.split() if len(w) > 2 or w == "ass") for k, v in LEXICONS.items()}
_ALL = frozenset().union(*_WORDS.values())
_BY_KEY = {single(w): w for w in _ALL}
_BY_LENGTH: dict[int, list[str]] = {}
for _w in _ALL:
    _BY_LENGTH.setdefault(len(_w), []).append(_w)


@lru_cache(maxsize=100_000)
def reveal(token: str) -> tuple[str, bool]:
    """A token without its disguise, and whether a lexicon's word was hidden in it."""
    token = token.strip(".!'’`-_~<>=#&%…")
    if token.startswith("*"):  # mark-up
        token = token.strip("*")
    if not token:
        return "", False
    if token.isalpha():
        if _RUN.search(token):
            shorter = _RUN.sub(r"\1", token)
            known = _BY_KEY.get(single(token)) or _BY_KEY.get(single(token).removesuffix("s"))
            return (known, True) if known else (shorter, False)
        return token, False
    if "*" in token and _MASKED.match(token.replace("@", "*").replace("$", "*")):
        pattern = token.replace("@", "*").replace("$", "*")
        if sum(c != "*" for c in pattern) >= 2:
            for plural in ("", "s"):
                if plural and not pattern.endswith("s"):
                    continue
                own = pattern.removesuffix(plural)
                for w in _BY_LENGTH.get(len(own), ()):
                    if all(a in ("*", b) for a, b in zip(own, w)):
                        return w, True
        return token.replace("*", ""), False
    if re.search(r"[a-z]", token) and re.search(r"[@$0134579€!|+]", token):
        for own in (token.translate(_LEET), token.replace("1", "l").translate(_LEET)):
            for w in (own, own.removesuffix("s"), own.removesuffix("es")):
                if w in _ALL:
                    return w, True
                if _RUN.search(w) and single(w) in _BY_KEY:
                    return _BY_KEY[single(w)], True
        if re.fullmatch(r"[a-z@$013]+", token) and re.search(r"[@$]|[a-z][013][a-z]", token):
            return token.translate(_LEET), False
    if "-" in token or "." in token:
        # kept together only if it is one disguised word
        joined = re.sub(r"[-._]", "", token)
        if joined in _ALL and re.fullmatch(r"(?:[a-z]{1,3}[-._])+[a-z]{1,3}", token):
            return joined, True
    return token, False


_JOINTS = re.compile(r"[-'’‐‑–—]")


def split_word(w: str) -> list[str]:
    """The words that hyphens, dashes and apostrophes join."""
    return [x for x in _JOINTS.split(w) if x]


def _unseen(sentence: str, text: str) -> bool:
    """Whether invisible characters stood in a sentence that came out as text."""
    return len(text) < len(sentence) and not sentence.isascii() and any(c in sentence for c in "​‌‍⁠﻿­")


def reveal_all(sentence: str) -> tuple[list[str], int]:
    """The sentence's words without disguise and how many lexicon words were hidden."""
    text, hidden = plain(sentence), 0
    invisible = _unseen(sentence, text)
    if _SPACED.search(text):

        def join(m: re.Match) -> str:
            nonlocal hidden
            w = re.sub(r"[ .\-_·]", "", m[0])
            if w in _ALL or w.removesuffix("s") in _ALL:
                hidden += 1
                return w
            # several spaced words in a row come without their ends: "a d u m b m o r o n"
            parts, at, known = [], 0, 0
            while at < len(w):
                for n in range(min(14, len(w) - at), 2, -1):
                    if w[at : at + n] in _ALL or w[at : at + n].removesuffix("s") in _ALL:
                        parts.append(w[at : at + n])
                        known += 1
                        at += n
                        break
                else:
                    if parts and known and parts[-1] not in _ALL:
                        parts[-1] += w[at]
                    else:
                        parts.append(w[at])
                    at += 1
            if known:
                hidden += known
                return " ".join(parts)
            return w if len(w) > 3 else m[0]

        text = _SPACED.sub(join, text)
    words = []
    for t in _TOKEN.findall(text):
        w, h = reveal(t)
        hidden += h
        words += split_word(w)
    if invisible and any(w in _ALL for w in words):
        hidden += 1
    return words, hidden


def _in(words: list[str], lexicon: frozenset) -> int:
    return sum(w in lexicon or (len(w) > 4 and (w.removesuffix("s") in lexicon or w.removesuffix("es") in lexicon)) for w in words)


# ---------------------------------------------------------------------------------------------- voters

_YOU = frozenset("you your yours yourself u du dich dir dein deine deinen deiner ihr euch tu toi ton ta tes te vous votre vos t eres tu tus ti tuyo vete enseñame ensename montre moi callate".split())
#: Phrases of words without disguise and apostrophes; "|" stands between alternatives of a word.
CURSES = """
shut up
shut your mouth|face|trap|gob
choke on
kill|hang|drown yourself
go to hell
rot|burn in hell
crawl back
drop dead
get lost
piss off
screw you
fuck you|off|yourself
i|we will|ll|shall|gonna kill|hurt|find|beat|destroy|break you|your
hope you die|choke|rot|suffer
break your neck|legs|bones|face|arms|fingers
watch your back
you will|ll regret|pay|suffer
your mother
halt das|dein|deine|die maul|fresse|klappe|schnauze
halt doch|endlich das|dein|deine|die maul|fresse|klappe|schnauze
verpiss|verzieh dich
fahr zur holle
scher dich
ich bring|bringe|schlag|schlage|mach|mache dich
ferme la|ta
ta gueule
va te faire
va mourir|crever
creve
je vais te|vous tuer|frapper
callate
cierra la|el boca|pico|hocico
vete al|a infierno|la|diablo
muerete
te voy a
"""
OUTCASTS = """
by birth
breed like
they breed
go back to your|where
send|ship them|you back
send every
should|must be shot|hanged|exterminated|gassed|deported|eradicated
gas them
kick|throw|drive them out
thrown out of
nobody would|will miss them|you
do not belong here
don t belong here
not welcome here
deserve|deserves to die
gehoren alle
muss|sollte man ausrotten|vergasen|rauswerfen
raus mit diesen|den|allen|euch
a eliminer|exterminer
il faut les
hay que echarlos|eliminarlos
"""
OFFERS = """
click now|here
in your area
free adult
wait|waits|waiting for you
tonight
touch me|myself|each
live cam|cams
call me
subscribe now
clothes off
take off your
makes me so
show me your
montre moi
ensename
zeig mir
had|have|having sex
moaned|moaning as
"""
REPORTS = """
complained|complaint|complaints
moderator|moderators
judged them
were removed
calmer
was reported
reported that
the tone of
rude|impolite
code of conduct
policy against
apologised|apologized|apologises|apologizes
insulting
abuse potential
training on
harassment policy|training
"""
TECHNICAL = """treated treatment dosing dosed doses received receive receives receiving exposed exposure necropsy finding
    findings retention maturation motility reflexes ossification litter tumour tumours mating suspension scored housed pregnant
    gestation assessed examined percent milligrams studied washed cages traced observed analysed gruppe tier tiere tieren erhielten
    untersucht animaux groupe chez dose animales grupo recibieron protocol certificate histology histological histologically
    histologic foetus foetuses"""


def _phrases(text: str) -> tuple[re.Pattern, frozenset]:
    """A pattern over words joined by blanks, and the words with one of which it begins wherever it matches."""
    lines = [x.split() for x in text.strip().splitlines()]
    own = "|".join(" ".join(f"(?:{w})" for w in x) for x in lines)
    return re.compile(f"(?:^| )(?:{own})(?= |$)"), frozenset(w for x in lines for w in x[0].split("|"))


_CURSE, _CURSE_WORDS = _phrases(CURSES)
_OUT, _OUT_WORDS = _phrases(OUTCASTS)
_OFFER, _OFFER_WORDS = _phrases(OFFERS)
_REPORT, _REPORT_WORDS = _phrases(REPORTS)
_DEGRADED = "|".join(sorted(DEGRADING))
_GROUP = re.compile(rf"^(?:[^ ]+ ){{0,6}}?(?:all|those|these|the|they|alle|diese|die|tous(?: ces| les)?|ces|les|los|las|todos(?: los)?|esos) (?:[^ ]+ ){{1,3}}?(?:are|sind|sont|son) (?:[^ ]+ ){{0,4}}?(?:{_DEGRADED})(?= |$)|(?:^| )they are (?:[^ ]+ ){{0,3}}(?:{_DEGRADED})(?= |$)")
_TECHNICAL = frozenset(TECHNICAL.split())

VOTERS = ("insult", "insult_weak", "foreign", "foreign_weak", "sexual", "sexual_weak", "address", "group", "outcast", "curse", "sell", "hidden", "several", "technical", "report")
POSITIVE = 13
BIT = {v: 1 << i for i, v in enumerate(VOTERS)}
_KINDS = ("insult", "insult_weak", "foreign", "foreign_weak", "sexual", "sexual_weak")
_LEXICAL = sum(BIT[k] for k in _KINDS)
_DEGRADES, _YOURS, _MAY_CURSE, _MAY_CAST, _MAY_REPORT, _MAY_OFFER = (1 << 20 + i for i in range(6))
_FLAGS = ((DEGRADING, _DEGRADES), (_YOU, _YOURS), (_CURSE_WORDS, _MAY_CURSE), (_OUT_WORDS, _MAY_CAST), (_REPORT_WORDS, _MAY_REPORT), (_OFFER_WORDS, _MAY_OFFER), (_TECHNICAL, BIT["technical"]))
_LOOK = _DEGRADES | _MAY_CURSE | _MAY_CAST | _MAY_REPORT | _MAY_OFFER


def word_bits(w: str) -> tuple[int, int]:
    """What one word votes for or may begin, and in how many lexicons it is."""
    own = [BIT[k] for k in _KINDS if _in([w], _WORDS[k])]
    return sum(own) | sum(flag for words, flag in _FLAGS if w in words), len(own)


def patterns(joined: str, hints: int) -> int:
    """Votes of the phrase voters on words joined by blanks; hints spare those no phrase of which can begin."""
    out = 0
    if hints & _MAY_CURSE and _CURSE.search(joined):
        out |= BIT["curse"]
    if hints & _MAY_OFFER and hints & _LEXICAL and _OFFER.search(joined):
        out |= BIT["sell"]
    if hints & _DEGRADES and _GROUP.search(joined):
        out |= BIT["group"]
    if hints & _MAY_CAST and _OUT.search(joined):
        out |= BIT["outcast"]
    if hints & _MAY_REPORT and _REPORT.search(joined):
        out |= BIT["report"]
    return out


def combined(hints: int, total: int, hidden: int) -> int:
    """Votes that words alone give."""
    out = hints & (_LEXICAL | BIT["technical"])
    if hints & _LEXICAL and hints & _YOURS:
        out |= BIT["address"]
    return out | (BIT["hidden"] if hidden else 0) | (BIT["several"] if total >= 2 else 0)


def votes(words: list[str], hidden: int) -> int:
    """The voters that don't abstain, as bits: the plain form of what Reader does for many sentences at once."""
    own = [word_bits(w) for w in words]
    hints = 0
    for b, _ in own:
        hints |= b
    return combined(hints, sum(n for _, n in own), hidden) | patterns(" ".join(words), -1 if hints & _LEXICAL else ~_LEXICAL)


def sentences(text: str) -> list[str]:
    return [s for s in _SENTENCE.split(text) if s and not s.isspace()]


SLOTS = 1 << 18
_FIGURE = re.compile(r"\d")


class Reader:
    """Sentences of many texts at once: their words, votes and features. Words and tokens once seen are kept."""

    def __init__(self) -> None:
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.words: list[str] = []
        self.bits, self.in_lexicons, self.hash = [], [], []
        self.tokens: dict[str, tuple[int, ...]] = {}
        self.hiding: set[str] = set()

    def _word(self, w: str) -> int:
        n = self.number.get(w)
        if n is None:
            n = self.number[w] = len(self.words)
            self.words.append(w)
            bits, inside = word_bits(w)
            self.bits.append(bits)
            self.in_lexicons.append(inside)
            self.hash.append(zlib.crc32(b"0" if _FIGURE.search(w) else w.encode("utf-8", "surrogatepass")))
        return n

    def _token(self, t: str) -> tuple[int, ...]:
        words, hidden = reveal(t)
        own = self.tokens[t] = tuple(self._word(x) for x in split_word(words))
        if hidden:
            self.hiding.add(t)
        return own

    def read(self, texts: list[str | None]) -> Sentences:
        if len(self.words) > 500_000 or len(self.tokens) > 1_000_000:
            self._forget()
        raw: list[str] = []
        owner: list[int] = []
        size: list[int] = []
        hidden: list[int] = []
        ids: list[int] = []
        get = self.tokens.get
        for k, text in enumerate(texts):
            if not text:
                continue
            own = sentences(text)
            spaced = _SPACED.search(text)
            for s in own:
                before = len(ids)
                low = plain(s)
                if spaced or not s.isascii() and (_SPACED.search(low) or _unseen(s, low)):
                    words, h = reveal_all(s)
                    ids.extend([self._word(w) for w in words])
                    hidden.append(h)
                else:
                    tokens = _TOKEN.findall(low)
                    found = list(map(get, tokens))
                    if None in found:
                        found = [self._token(t) if x is None else x for t, x in zip(tokens, found)]
                    ids.extend(chain.from_iterable(found))
                    hidden.append(0 if self.hiding.isdisjoint(tokens) else sum(t in self.hiding for t in tokens))
                size.append(len(ids) - before)
                owner.append(k)
            raw += own
        return Sentences(self, raw, np.array(owner, np.int64), np.array(size, np.int64), np.array(hidden, np.int64), np.array(ids, np.int64))


class Sentences:
    """What a Reader has read: raw sentences, the text each is of, its votes and its features."""

    def __init__(self, reader: Reader, raw: list[str], owner: np.ndarray, size: np.ndarray, hidden: np.ndarray, ids: np.ndarray) -> None:
        self.raw, self.owner, self.size, self.ids = raw, owner, size, ids
        self.of = np.repeat(np.arange(len(size)), size)
        self.start = np.cumsum(size) - size
        some = np.flatnonzero(size)
        hints, total = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        if len(some):
            hints[some] = np.bitwise_or.reduceat(np.array(reader.bits, np.int64)[ids], self.start[some])
            total[some] = np.add.reduceat(np.array(reader.in_lexicons, np.int64)[ids], self.start[some])
        lexical = hints & _LEXICAL != 0
        self.votes = hints & (_LEXICAL | BIT["technical"])
        self.votes |= np.where(lexical & (hints & _YOURS != 0), BIT["address"], 0) | np.where(hidden > 0, BIT["hidden"], 0) | np.where(total >= 2, BIT["several"], 0)
        for i in np.flatnonzero(hints & _LOOK).tolist():
            joined = " ".join([reader.words[w] for w in ids[self.start[i] : self.start[i] + size[i]].tolist()])
            self.votes[i] |= patterns(joined, int(hints[i]))
        self.hash = np.array(reader.hash, np.int64)[ids] if len(ids) else np.zeros(0, np.int64)

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """Slots of words, of pairs of neighbours (with the sentence's ends) and of votes; and the sentence of each."""
        n = len(self.size)
        first = np.zeros(len(self.ids), bool)
        first[self.start[self.size > 0]] = True
        before = np.where(first, 7, np.concatenate([[0], self.hash[:-1]]) if len(self.hash) else self.hash)
        last = np.flatnonzero(self.size)
        final = self.hash[self.start[last] + self.size[last] - 1]
        pair = lambda a, b: (a * 1_000_003 + b * 31 + 17) % 4_294_967_291 % SLOTS
        cast = [(np.flatnonzero(self.votes >> k & 1), zlib.crc32(f"#{k}".encode()) % SLOTS) for k in range(len(VOTERS))]
        slots = np.concatenate([self.hash % SLOTS, pair(before, self.hash), pair(final, 11), *(np.full(len(rows), slot) for rows, slot in cast)])
        of = np.concatenate([self.of, self.of, last, *(rows for rows, _ in cast)])
        assert n == 0 or not len(of) or of.max() < n
        return slots.astype(np.int64), of.astype(np.int64)


# ---------------------------------------------------------------------------------------------- label model


def _states(n: int) -> np.ndarray:
    return ((np.arange(1 << n)[:, None] >> np.arange(n)) & 1).astype(np.float32)


class ClassModel:
    """A log-linear model of one class over all patterns of votes: a weight for each voter and for each chosen pair."""

    def __init__(self, v: np.ndarray, weight: np.ndarray, least: np.ndarray, most_pairs: int, before: ClassModel | None = None) -> None:
        """v: observed patterns, weight: how often each is of the class; least: added to each voter's count of votes.

        Pairs and the weights to start from are taken from the model before, if there is one.
        """
        total = weight.sum()
        self.rate = np.clip((v.T @ weight + least) / (total + 4), 1e-5, 0.98)
        self.theta = before.theta if before else None
        self.pairs = before.pairs if before else self._correlated(v, weight, total, most_pairs)
        expected = self.rate[[i for i, _ in self.pairs]] * self.rate[[j for _, j in self.pairs]] if self.pairs else np.zeros(0)
        together = np.array([(v[:, i] * v[:, j]) @ weight for i, j in self.pairs])
        # counts of both together are drawn to those of independent voters by ten sentences
        self.goal = np.concatenate([self.rate, (together + 10 * expected) / (total + 10)])

    @staticmethod
    def _correlated(v: np.ndarray, weight: np.ndarray, total: float, most_pairs: int) -> list[tuple[int, int]]:
        x = v - (weight @ v) / max(total, 1e-9)
        cov = (x * weight[:, None]).T @ x / max(total, 1e-9)
        sd = np.sqrt(np.diag(cov)) + 1e-6
        rho = np.triu(cov / sd[:, None] / sd[None, :], 1)  # voters that copy each other; that kinds of passages exclude others is no such thing
        own = np.argsort(rho, axis=None)[::-1][:most_pairs]
        return [(int(k) // v.shape[1], int(k) % v.shape[1]) for k in own if rho.flat[k] > 0.1]

    def fitted(self, states: np.ndarray) -> np.ndarray:
        """Log probability of each state, fitted to the rates by damped steps of all weights at once."""
        rounds = 80 if self.theta is None else 20
        features = np.concatenate([states, *(states[:, i : i + 1] * states[:, j : j + 1] for i, j in self.pairs)], axis=1)
        theta = np.concatenate([np.log(self.rate / (1 - self.rate)), np.zeros(len(self.pairs))]) if self.theta is None or not self.pairs else self.theta
        z = features @ theta.astype(np.float32)
        goal = np.clip(self.goal, 1e-7, 1 - 1e-7)
        for _ in range(rounds if self.pairs else 0):
            p = np.exp(z - z.max())
            p /= p.sum()
            now = np.clip(features.T @ p, 1e-9, 1 - 1e-9)
            step = np.log(goal / now) - np.log((1 - goal) / (1 - now))
            step = np.clip(0.3 * step, -0.5, 0.5)
            theta = np.clip(theta + step, -14, 14)
            z = features @ theta.astype(np.float32)
        self.theta = theta
        return z.astype(float) - z.max() - np.log(np.exp(z.astype(float) - z.max()).sum())


class LabelModel:
    """The prior, the model of both classes, and the posterior of each vote pattern."""

    def __init__(self, patterns: Counter, labelled: list[tuple[int, int]], prior: float = 0.02, rounds: int = 20, most_pairs: int = 24) -> None:
        codes = np.array(sorted({0, *patterns, *(c for c, _ in labelled)}), dtype=np.int64)
        n = np.array([patterns.get(int(c), 0) for c in codes], dtype=float)
        states = _states(len(VOTERS))
        v = states[codes].astype(float)
        place = {int(c): i for i, c in enumerate(codes)}
        pos, all_ = np.zeros(len(codes)), np.zeros(len(codes))
        for c, y in labelled:
            pos[place[c]] += y
            all_[place[c]] += 1
        pos = np.where(pos < 0.05 * all_, 0, np.where(pos > 0.95 * all_, all_, pos))  # a few labels are wrong
        side = np.arange(len(VOTERS)) < POSITIVE

        def told(post):  # type: ignore[no-untyped-def]
            """A model's posterior weighs as two labelled samples of the pattern."""
            return (2 * post + pos) / (2 + all_)

        # start: votes of one side only tell
        strong = v[:, :POSITIVE] @ np.where(np.isin(VOTERS[:POSITIVE], ["insult_weak", "foreign_weak", "sexual_weak", "address", "several"]), 0.5, 1.0)
        post = told(1 / (1 + np.exp(-(4 * strong - 4 - 3 * v[:, POSITIVE:].sum(1)))))
        self.prior = prior
        self.on: ClassModel | None = None
        self.off: ClassModel | None = None
        for k in range(rounds):
            keep = k >= 3  # which pairs are correlated is settled by then
            self.on = ClassModel(v, n * post + pos, np.where(side, 1, 0.2), most_pairs, self.on if keep else None)
            self.off = ClassModel(v, n * (1 - post) + all_ - pos, np.where(side, 0.02, 1), most_pairs, self.off if keep else None)
            self.prior = float(np.clip((n * post).sum() / max(n.sum(), 1), 1e-4, 0.3))
            z = np.log(self.prior / (1 - self.prior)) + (self.on.fitted(states) - self.off.fitted(states))[codes]
            # votes for passages alone never speak against one, nor the other way about
            z = np.where((v[:, :POSITIVE].sum(1) == 0), np.minimum(z, -3), z)
            post = told(1 / (1 + np.exp(-np.clip(z, -30, 30))))
        self.posterior = dict(zip(codes.tolist(), post.tolist()))


# ---------------------------------------------------------------------------------------------- classifier


def train(slots: np.ndarray, of: np.ndarray, y: np.ndarray, worth: np.ndarray, rounds: int = 150, l2: float = 1e-5) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels, by Adam over all rows of some worth each; both classes weigh the same."""
    scale = 1 / np.sqrt(np.maximum(1, np.bincount(of, minlength=len(y))))
    weight = worth * np.where(y >= 0.5, 0.5 / max(1, worth[y >= 0.5].sum()), 0.5 / max(1, worth[y < 0.5].sum()))
    used, slot = np.unique(slots, return_inverse=True)
    w, b = np.zeros(len(used)), 0.0
    m, s = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for t in range(1, rounds + 1):
        z = np.bincount(of, weights=w[slot], minlength=len(y)) * scale + b
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight
        grad = np.append(np.bincount(slot, weights=(g * scale)[of], minlength=len(used)) + l2 * w, g.sum())
        m, s = 0.9 * m + 0.1 * grad, 0.99 * s + 0.01 * grad**2
        step = 0.2 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    full = np.zeros(SLOTS, dtype=np.float32)
    full[used] = w
    return full, float(b)


# ---------------------------------------------------------------------------------------------- the operator


def _survey(text: str, most: int):
    """pattern, n, of a partition; and pattern, draw, sentence, of the sentences of each pattern with the least hashes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader, counts, kept = Reader(), Counter(), {}
        for pdf in batches:
            texts = [t if isinstance(t, str) else None for t in pdf[text]]
            seeds = [zlib.crc32(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts]
            read = reader.read(texts)
            at, last = 0, -1
            for own, p, s in zip(read.owner.tolist(), read.votes.tolist(), read.raw):
                counts[p] += 1
                at, last = (at + 1, own) if own == last else (0, own)
                draw = zlib.crc32(b"%d" % at, zlib.crc32(s.encode("utf-8", "surrogatepass"), seeds[own]))
                heap = kept.setdefault(p, [])
                room = most * (10 if p in QUIET else 1)
                if len(heap) < room:
                    heapq.heappush(heap, (-draw, s))
                elif -draw > heap[0][0]:
                    heapq.heapreplace(heap, (-draw, s))
        rows = [(p, n, None, None) for p, n in counts.items()] + [(p, None, -d, s) for p, heap in kept.items() for d, s in heap]
        for at in range(0, len(rows), 10_000):
            yield pd.DataFrame(rows[at : at + 10_000], columns=["pattern", "n", "draw", "sentence"]).astype({"n": "Int64", "draw": "Int64"})

    return run


#: Patterns that say nothing for a passage: ten times as many of their sentences are drawn.
QUIET = frozenset((0, BIT["technical"]))


class Model:
    """A fitted model: label model, weights of the classifier, and the scores of texts."""

    def __init__(self, label: LabelModel, weights: np.ndarray, bias: float) -> None:
        self.label, self.weights, self.bias = label, weights, bias

    def texts(self, reader: Reader, texts: list[str | None]) -> np.ndarray:
        """Score of the worst sentence of each text; 0 for null, empty and blank ones."""
        read, out = reader.read(texts), np.zeros(len(texts))
        if len(read.raw):
            slots, of = read.features()
            n = np.maximum(1, np.bincount(of, minlength=len(read.raw)))
            z = np.bincount(of, weights=self.weights[slots], minlength=len(read.raw)) / np.sqrt(n) + self.bias
            np.maximum.at(out, read.owner, 1 / (1 + np.exp(-np.clip(z, -30, 30))))
        return out


def fit(documents: DataFrame, samples: DataFrame, text: str = "text", category: str = "category", sample_rows: int = 60_000, per_pattern: int = 2_000) -> Model:
    """Label model over all sentences of documents; classifier on about sample_rows of them at most and on the samples.

    The classifier's training sentences are those with the least hashes of text and place, per_pattern of each vote
    pattern (ten times as many of the silent ones); labelled samples are drawn by hash too, sample_rows at most. Both
    bounds are parameters; the counts under the label model are not sampled.
    """
    some = spread(documents.select(text).where(F.col(text).isNotNull()))
    seen = materialised(some.mapInPandas(_survey(text, per_pattern * 2), "pattern long, n long, draw long, sentence string"))
    # at most 2^voters rows come back
    counts = Counter({r["pattern"]: r["n"] for r in seen.where("n is not null").groupBy("pattern").agg(F.sum("n").alias("n")).collect()})
    known = samples.select(text, category).where(F.col(text).isNotNull()).orderBy(F.xxhash64(text, category), text, category).limit(sample_rows).collect()
    reader = Reader()
    labelled = reader.read([r[0] for r in known])
    truth = np.array([float(r[1] != "none") for r in known])
    by_sample = np.zeros(len(known), np.int64)
    np.bitwise_or.at(by_sample, labelled.owner, labelled.votes)
    label = LabelModel(counts, [(int(p), int(y)) for p, y in zip(by_sample, truth)])
    wanted = {p: min(n, per_pattern * (10 if p in QUIET else 1)) for p, n in counts.items()}
    share = min(1.0, sample_rows / max(1, sum(wanted.values())))
    limits = {p: int(share * w / counts[p] * 2**32) for p, w in wanted.items()}
    bound = F.create_map(*[F.lit(x) for p, m in limits.items() for x in (p, m)]) if limits else None
    drawn = sorted((r[0], r[1]) for r in seen.where("sentence is not null").where(F.col("draw") < bound[F.col("pattern")]).select("sentence", "pattern").collect()) if limits else []
    read = reader.read([s for s, _ in drawn])
    slots, of = read.features()
    # a sentence that its own marks would split again is one row
    y = np.array([label.posterior.get(p, 0.0) for _, p in drawn])
    # a sample's label counts unless the voters clearly contradict it
    held = np.array([label.posterior.get(int(p), label.prior) for p in by_sample])
    told = np.where(np.abs(held - truth) < 0.9, truth, held) if len(known) else np.zeros(0)
    more, own = labelled.features()
    # the strong lexicons' words, as sentences of their own: some may not stand in the corpus
    strong = sorted(w for k in ("insult", "foreign", "sexual") for w in _WORDS[k])
    lexical = reader.read(strong)
    words, each = lexical.features()
    weights, bias = train(
        np.concatenate([slots, more, words]),
        np.concatenate([read.owner[of], len(drawn) + labelled.owner[own], len(drawn) + len(known) + lexical.owner[each]]),
        # a sentence of words that nothing is known of is none: the last row has no features
        np.concatenate([y, told, np.full(len(strong), 0.95), [0.0]]),
        np.concatenate([np.ones(len(y) + len(told)), np.full(len(strong), 0.1), [0.5 * (len(y) + len(told))]]),
    )
    return Model(label, weights, bias)


def score(documents: DataFrame, model: Model, key: str = "doc_id", text: str = "text", *more: str) -> DataFrame:
    """key, score and the columns more: one row for each row of documents. A narrow map; the model (1 MB) is sent once."""
    sent = documents.sparkSession.sparkContext.broadcast(model)
    kinds = ", ".join(f"{c} {documents.schema[c].dataType.simpleString()}" for c in (key, *more))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, reader = sent.value, Reader()
        for b in batches:
            scores = own.texts(reader, b.column(b.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(scores)], names=[key, *more, "score"])

    return spread(documents.select(key, *more, F.col(text).alias("_text"))).mapInArrow(run, f"{kinds}, score double")


THRESHOLD = 0.5
