"""Template residue, filler, error messages and script notices found in texts.

Naive Bayes from positive and unlabelled passages: windows around trusted marks (an
unfilled slot, "lorem ipsum", a status line, ...) are positive, all others unlabelled, and
expectation-maximization moves the unlabelled ones to where they belong.  A text is cut
into overlapping windows of a few words; each is scored, and the best window decides for
the record, by a cut calibrated on texts held out.  The patterns label the fit's sample and have no
say in the decision.  Code and quoted speech are masked before anything is read, so that
naming such a thing isn't having it.
"""

from __future__ import annotations

import html
import json
import math
import re as plain
from array import array
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import regex as re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.sources.shared import spread

# --- Fixed values: what is trusted to be residue, and what is ordinary wiki text. ---

#: Behaviour switches of the wiki software, in English and the other languages read here.
MAGIC = """NOTOC FORCETOC TOC NOEDITSECTION NEWSECTIONLINK NONEWSECTIONLINK NOGALLERY HIDDENCAT EXPECTUNUSEDCATEGORY
NOCONTENTCONVERT NOCC NOTITLECONVERT NOTC START END INDEX NOINDEX STATICREDIRECT DISAMBIG EXPECTED_UNCONNECTED_PAGE ARCHIVEDTALK NOTALK
KEIN_INHALTSVERZEICHNIS KEININHALTSVERZEICHNIS INHALTSVERZEICHNIS_ERZWINGEN INHALTSVERZEICHNIS ABSCHNITTE_NICHT_BEARBEITEN
AUCUNSOMMAIRE AUCUNETDM FORCERSOMMAIRE FORCERTDM SOMMAIRE TDM SECTIONNONEDITABLE
NOTDC SIN_TDC FORZAR_TDC FORZARTDC TDC NO_EDITAR_SECCION NOEDITARSECCION""".split()

#: Slots of page-building systems.
SLOTS = r"""\{\{\{[^{}\n]{1,60}\}\}\}
\$\{[^{}\n]{1,60}\}
#\{[^{}\n]{1,60}\}
<%[=-]?[^%\n]{1,60}%>
\{%[^%\n]{1,60}%\}
%%[\w-]{2,40}%%
@@[\w-]{2,40}@@
(?<![\w$])\$\p{L}[\w-]{1,40}\$(?!\w)
%\([\w-]{1,40}\)[sdif]\b
\{\{\s*(?:[\w-]+\.)+[\w-]+\s*\}\}
(?<![{$#%\w])\{\p{L}[\w .-]{0,40}\}(?!\})
(?<!\w)__(?!MAGIC__)[\p{L}][\w-]*?__(?!\w)"""

#: Instructions to an editor, and values of programs, where a fact belongs.
INSTRUCTIONS = r"""[\[(<*]\s?(?:please )?(?:insert|enter|fill in|inserer|insérer|insertar|inserte|indiquer|escriba|escribir|todo|tbd|fixme)\b[^\])>*\n|.]{0,60}[\])>*]
[\[(<*]\s?(?:please )?(?:add|type|your|hier|votre|su|tu|ihre?)\b[^\])>*\n|.]{1,60}\b(?:here|ici|aquí|hier|einfügen|eintragen)\s?[\])>*]
[\[(<*]\s?[^\])>*\n|.\[(<]{1,50}\b(?:goes here|einfügen|eintragen|ergänzen|à compléter|à remplir|por completar)\s?[\])>*]
[=|]\s*(?:todo|tbd|tba|fixme|xxx)\b\s*(?:\||\}\}|$)"""
EMPTIES = r"\[object Object\]|\(null\)|#N/A(?!\w)|#REF!|#VALUE!|#NAME\?|#DIV/0!"
_V = r"(?:null|NULL|undefined|NaN|nan|None|nil)"
#: Such a word where the fact itself should stand.
FACTS = rf"""'''{_V}'''
(?:\bis|\bist|\best|\bes|\bwas|\bwar|\bhad|\bhas|\btenía|\bof|\bin|\ben|\bde|\bvon|:)\s(?:an?\s|eine?\s|une?\s|un\s)?{_V}(?=\s*[.,:;|)}}]|\s(?:in|de|en|it|had|habitants?|habitantes|inhabitants|einwohner|von|ist|est|es)\b)
\{{\{{(?:[\w-]+\s)?{_V}(?:-stub)?\}}\}}
[=|]\s*{_V}\s*(?:\||\}}\}}|$)
\({_V}\)"""

#: Filler put in for prose to come.
FILLER = r"""lorem ipsum
dolor sit amet
(?:sample|dummy|filler|placeholder) (?:text|copy|paragraph|sentence|content)
(?:text|content|description|body copy) (?:is )?(?:coming soon|to follow|to be supplied|goes here|to come)
(?:blind|platzhalter|beispiel|füll)text
(?:faux texte|texte factice|phrase factice|texte d['’]exemple|contenu à venir|texte à venir)
(?:texto (?:de relleno|de ejemplo|simulado|ficticio)|frase ficticia|contenido próximamente|próximamente contenido)
blah blah blah
text text text
asdf asdf
more words will follow
hier steht später
(?:folgt|kommt) in kürze"""

#: Words of the usual Latin filler; five in a row are filler too.
LATIN = """lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim minim
veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse
cillum fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum purus
felis lacus ornare vitae augue massa nibh porta urna dictum mauris vestibulum pellentesque tellus risus turpis viverra lectus semper cursus""".split()

#: Messages of failed requests and programs.
ERRORS = r"""\b(?:http(?:/\d(?:\.\d)?)?|error|status|fehler|erreur|estado)\W{0,3}[45]\d\d\b
\b[45]\d\d (?:bad request|unauthorized|forbidden|not found|method not allowed|request timeout|gone|too many requests|internal server error|not implemented|bad gateway|service unavailable|gateway time-?out)
traceback\W+(?:\(most recent call last\)|\w+error)
\b\w{3,}(?:error|exception)\b.{0,20}\bat line \d+
"?error"?\W{0,4}\{\W{0,3}code
["']code["']:\W{0,2}[45]\d\d\b
(?:cannot|can't|could not|unable to) connect to (?:the )?database
something went wrong
session (?:has )?expired
down for maintenance
(?:your|this) (?:address|access|request|ip)\b.{0,15} (?:has been|was) (?:blocked|denied)
unusual (?:traffic|activity)
unexpected condition\b.{0,40}\brequest
unexpected error (?:has )?occurred
backend fetch failed
guru meditation
query failed
deadlock found
marked as crashed
lost connection
link you followed
nothing here!
(?:seite|version|revision) gibt es nicht mehr
zu viele anfragen
trop de requêtes
demasiadas (?:solicitudes|peticiones)
took too long to respond
too many requests
moved or deleted
(?:page|revision|article|resource|file) no longer exists
access denied
(?:please )?try again (?:later|in \d+)
unable to (?:reach|load|connect to|process|complete) (?:the |this |your )?(?:article|page|server|request|database|backend)
(?:page|revision|article|resource|file|address)\b.{0,30}\bcould not be found
es ist ein fehler aufgetreten
versuchen sie es.{0,20}später
wegen wartung
(?:dienst|seite|server|wartung)\b.{0,30}\bnicht erreichbar
zugriff verweigert
seite wurde nicht gefunden
service (?:momentanément |temporairement )?indisponible
une erreur (?:est survenue|s['’]est produite)
accès refusé
page (?:demandée )?(?:est )?introuvable
se ha producido un error
inténtelo de nuevo
servicio no disponible
acceso denegado
no se ha encontrado la página
(?:page|resource|article|file) (?:you requested )?(?:was not|could not be|cannot be) found
fatal error
stack trace
erreur interne du serveur
interner serverfehler
error interno del servidor"""

#: Notices that scripts must be allowed.
NOTICES = r"""(?:enable|activate|turn on|switch on|allow|requires?|needs?) (?:java ?scripts?|js\b|scripts?\b|(?:active )?scripting)
java ?script is (?:disabled|required|turned off|not enabled)
turn java ?script on
(?:without|with) (?:js|java ?script) (?:enabled|disabled)
(?:aktivieren|benötigt|erfordert|einschalten).{0,20}(?:java ?script|skripte)
(?:java ?script|skripte).{0,20}(?:aktivieren|einschalten|benötigt)
(?:activer|autoriser|nécessite|requiert).{0,25}(?:java ?script|scripts)
(?:active|habilite|activar|habilitar|necesita|requiere).{0,15}(?:java ?script|scripts)
(?:java ?script|skripte?|scripts?)\b.{0,30}(?:deaktiviert|désactivés?|desactivad[oa]s?|disabled|blocked|turned off)
(?:does not|doesn['’]t|führt keine|n['’]exécute pas|no ejecuta).{0,20}(?:java ?script|skripte|scripts?)\b
<noscript>
(?:script|ad) ?blockers? must be
scripts? (?:and cookies )?must be (?:allowed|enabled)"""


def _any(patterns: str) -> str:
    return "|".join(p for p in patterns.split("\n") if p)


_SLOT = re.compile(_any(SLOTS.replace("MAGIC__", "(?:" + "|".join(MAGIC) + ")__")))
_FACTS = plain.compile(_any(FACTS))
_LATIN = plain.compile(r"(?:\b(?:LATIN)\b[\s.,]+){4}(?:LATIN)\b".replace("LATIN", "|".join(LATIN)))
#: Patterns in lower case, for the passage in lower case: cheaper than ignoring case.
_LOWER = [plain.compile(_any(p)) for p in (INSTRUCTIONS, EMPTIES.lower(), FILLER, ERRORS, NOTICES)]
_LATIN_WORDS = frozenset(LATIN)
_WORD = plain.compile(r"\w+")

_CODE = re.compile(r"<(code|pre|nowiki|syntaxhighlight|source|math|kbd|samp)\b(?:[^<>]*[^/<>])?>.*?</\1\s*>", re.I | re.S)
_MARKS = re.compile(r"<!--.*?-->|[\u200b-\u200f\u2060\ufeff\u00ad]|(?i:__(?:" + "|".join(MAGIC) + r")__)", re.S)
_QUOTED = re.compile(
    r"""(?<!(?:[={\[]|":)\s?)(?<!\w)"[^"\n{}]{3,240}"(?!\s?[:}])|«[^«»]{2,240}»|„[^„“”]{2,240}[“”]|“[^“”]{2,240}”|(?<!')''(?!')[^'\n]{2,240}(?:'\p{L}[^'\n]{0,200}){0,4}''(?!')|(?<![={\[]\s?)(?<![\w'])'[^'\n{}]{8,240}(?:(?<=\w)'\w[^'\n]{0,200}){0,3}'(?![\w'])"""
)
#: Prose that names an error page or a technique, and so isn't one.
_NAMED = plain.compile(
    r"(?:error page|fehlerseite|page d['’]erreur|página de error) (?:shows|zeigt|montre|muestra)|(?:uses?|used|verwendet|benutzt|nutzt|utilise|usa|utiliza) (?:java ?script)(?= (?:since|seit|depuis|desde))",
    plain.I,
)
_MOJIBAKE = re.compile(r"[\u00c2-\u00f4][\u0080-\u00bf€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]{1,3}")
_PART = re.compile(r"\n\s*\n|</?(?:p|h[1-6]|li|div|tr|td|body|title|html|head)\b[^<>]*>|\n(?=[|!=*#{}])", re.I)
_DOUBLE = re.compile(r"\\n|\\t")
_PIECE = plain.compile(r"[^\W\d_]+(?:\.[^\W\d_]\w*)*|\d+|_+|'+|\{+|\}+|\[+|\]+|=+|\|+|@+|%+|\*+|[^\w\s.,;]")
#: Names of files by their endings, and programs' empty values as they are spelled.
_FILES = ("svg", "jpg", "jpeg", "png", "gif", "webp", "ogg", "pdf")
_VALUES = {"null", "NULL", "undefined", "NaN", "nan", "None", "nil"}


def _mend(text: str) -> str:
    """Undo one round of UTF-8 read as Windows-1252, where the whole run allows it."""

    def one(m: re.Match) -> str:
        for code in ("cp1252", "latin-1"):
            try:
                return m.group(0).encode(code).decode("utf-8")
            except (UnicodeEncodeError, UnicodeDecodeError):
                pass
        return m.group(0)

    return _MOJIBAKE.sub(one, text)


def visible(text: str) -> str:
    """The text as a reader would see it, without code and quotations, entities resolved."""
    if text.startswith('{"') and text.rstrip().endswith("}"):
        try:
            held = json.loads(text, strict=False)
            inner = held.get("text") if isinstance(held, dict) else None
            text = inner if isinstance(inner, str) else text
        except ValueError:
            text = _DOUBLE.sub("\n", text)
    if "&" in text:
        text = html.unescape(html.unescape(text))
    text = _MARKS.sub("", text)
    if _MOJIBAKE.search(text):
        text = _mend(text)
    if "</" in text:
        text = _CODE.sub(" □ ", text)
    return text


def _mask(quote: re.Match) -> str:
    """A mark for a quotation, unless it is ordinary speech with a slot left open in it."""
    said = quote.group(0)
    if "_" in said or "{" in said or "%" in said or "@@" in said or "$" in said:
        around = _SLOT.sub(" ", said)
        if around != said and len(around.split()) > 4:
            return said
    return " ■ "


#: What a quotation begins with.
_SIGNS = plain.compile("[\"'«„“]")


def passages(text: str | None) -> Iterator[str]:
    """Paragraphs, rows and headings of the visible text, on one line each, quotations masked."""
    if not text:
        return
    for part in _PART.split(visible(text)):
        if part and not part.isspace():
            line = " ".join(part.split())
            if _SIGNS.search(line):
                line = _QUOTED.sub(_mask, line)
            low = line.lower()
            if "script" in low or "err" in low or "fehl" in low:  # what all of its wordings hold
                line = _NAMED.sub(" ■ ", line)
            yield line


def _kind(piece: str) -> str:
    """What a word or mark is told as: itself in lower case, or its kind."""
    if piece[0].isdigit():
        return "▸number"
    if piece in _VALUES:
        return "▸value"
    if "." in piece:
        return "▸file" if piece.rpartition(".")[2].lower() in _FILES else "▸dotted"
    return piece.casefold()


class _Cached(dict):
    """What ``make`` makes of a word, kept for the many times it comes again; a bounded number of words."""

    def __init__(self, make: Callable[[str], tuple]):
        super().__init__()
        self.make = make

    def __missing__(self, word: str) -> tuple:
        if len(self) > 200_000:
            self.clear()
        made = self[word] = self.make(word)
        return made


#: No piece spans a blank, so a passage's pieces are those of its words between blanks.
_PIECES = _Cached(lambda word: tuple(map(_kind, _PIECE.findall(word))))


def pieces(passage: str) -> list[str]:
    """Words and marks of a passage.  Numbers, dotted names, files and empty values are told by kind."""
    return list(chain.from_iterable(map(_PIECES.__getitem__, passage.split())))


def _searches(passage: str) -> Iterator[tuple[plain.Pattern, str]]:
    """The trusted patterns, each with the spelling of the passage it is for; costly ones only where they can match."""
    low = passage.lower()
    yield _SLOT, passage
    if any(v in passage for v in _VALUES):
        yield _FACTS, passage
    for p in _LOWER:
        yield p, low
    if sum(w in _LATIN_WORDS for w in _WORD.findall(low)) > 4:
        yield _LATIN, low


def _trusted_at(passage: str) -> list[tuple[int, int]]:
    return [m.span() for p, said in _searches(passage) for m in p.finditer(said)]


def is_trusted(passage: str) -> bool:
    return any(p.search(said) for p, said in _searches(passage))


class ResidueModel:
    """Weights of words and word pairs (log odds of residue), the prior odds of a window, and the score from which a
    document is told to have residue (``calibrated_cut``)."""

    def __init__(self, words: dict[str, float], pairs: dict[tuple[str, str], float], unknown: float, prior: float, window: int, cut: float = math.inf):
        self.number = {w: i for i, w in enumerate(words)}
        self.weight = np.array([*words.values(), unknown])
        size = len(self.weight)
        met = sorted((self.number.get(a, size - 1) * size + self.number.get(b, size - 1), v) for (a, b), v in pairs.items())
        self.pair, self.pair_weight = np.array([k for k, _ in met] or [-1]), np.array([v for _, v in met] or [0.0])
        self.prior, self.window, self.cut = prior, window, cut

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("ids", "known")}

    def _ids(self, passage: str) -> Iterator[int]:
        if "ids" not in self.__dict__:
            get, unknown = self.number.get, len(self.weight) - 1
            self.ids = _Cached(lambda word: tuple(get(p, unknown) for p in _PIECES.make(word)))
        return chain.from_iterable(map(self.ids.__getitem__, passage.split()))

    def best_windows(self, told: Iterable[Iterable[Iterable[int]]]) -> np.ndarray:
        """Per text (passages of numbered pieces) the log odds of its best window: 3 to ``window`` pieces, or a whole shorter
        passage.  Minus infinity where there is none.  All windows of all texts are scored at once, by running sums."""
        flat, ends, owners = array("q"), [], []
        n = 0
        for n, passages_ in enumerate(told, 1):
            for p in passages_:
                before = len(flat)
                flat.extend(p)
                if len(flat) > before:
                    ends.append(len(flat))
                    owners.append(n - 1)
        best = np.full(n, -np.inf)
        if not ends:
            return best
        ids, ends = np.frombuffer(flat, np.int64), np.array(ends)
        length = np.diff(ends, prepend=0)
        left = np.repeat(ends, length) - np.arange(len(ids))  # pieces from here to the passage's end
        key = ids[:-1] * len(self.weight) + ids[1:]
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        beside = np.where((self.pair[at] == key) & (left[:-1] > 1), self.pair_weight[at], 0.0)
        # One running sum over pieces and the pairs before them; a window leaves out the pair before its first piece.
        step = self.weight[ids]
        run = np.cumsum(step + np.concatenate([[0.0], beside]))
        base = run - step
        top = np.full(len(ids), -np.inf)
        whole = np.repeat(length, length)
        for width in range(1, self.window + 1):
            fits = np.flatnonzero((left >= width) if width >= 3 else (left == width) & (whole == width))
            top[fits] = np.maximum(top[fits], run[fits + width - 1] - base[fits])
        np.maximum.at(best, np.repeat(owners, length), top)
        return best + self.prior

    def scores(self, texts: Iterable[str | None]) -> np.ndarray:
        """The log odds of each text's best window.  Passages met again, as in revisions of one page, are scored once."""
        known: dict[str, float] = self.__dict__.setdefault("known", {})
        if len(known) > 50_000:
            known.clear()
        told = [list(passages(t)) for t in texts]
        fresh = list(dict.fromkeys(p for held in told for p in held if p not in known))
        now = dict(zip(fresh, self.best_windows([self._ids(p)] for p in fresh).tolist()))
        out = np.array([max((now[p] if p in now else known[p] for p in held), default=-math.inf) for held in told])
        known.update((p, v) for p, v in now.items() if len(p) < 1000)
        return out

    def score(self, text: str | None) -> float:
        return float(self.scores([text])[0])

    def marked_scores(self, told: list[list[tuple[list[str], str]]]) -> np.ndarray:
        """The same for texts whose pieces are known."""
        get, unknown = self.number.get, len(self.weight) - 1
        return self.best_windows([[get(w, unknown) for w in words] for words, _ in passages_] for passages_ in told)


def marked_pieces(text: str) -> list[tuple[list[str], str]]:
    """The words of each passage, and for each word 1 if a trusted mark touches it, else 0."""
    out = []
    for passage in passages(text):
        words = pieces(passage)
        if words:
            spans = _trusted_at(passage)
            marks = "".join("01"[any(m.start() < b and m.end() > a for a, b in spans)] for m in _PIECE.finditer(passage)) if spans else "0" * len(words)
            out.append((words, marks))
    return out


def fit(texts: list[str], **how) -> ResidueModel:
    """Fit on texts (see ``fit_marked``)."""
    return fit_marked([marked_pieces(t) for t in texts], **how)


def fit_marked(texts: list[list[tuple[list[str], str]]], kept: float = 0.99, **how) -> ResidueModel:
    """Fit on a sample of texts (see ``_fit_windows``), and calibrate the cut on halves of it that were each held out."""
    model = _fit_windows(texts, **how)
    halves = texts[::2], texts[1::2]
    scores = np.concatenate([_fit_windows(other, **how).marked_scores(held) for held, other in (halves, halves[::-1])])
    marked = np.array([any("1" in marks for _, marks in told) for half in halves for told in half], bool)
    model.cut = calibrated_cut(scores[marked], kept)
    return model


#: Bounds of the cut: a chance of 0.99 and one of 0.999 that the best window is residue.
LEAST_CUT, MOST_CUT = math.log(99), math.log(999)


def calibrated_cut(scores: np.ndarray, kept: float) -> float:
    """The score that the share ``kept`` of the texts with a trusted mark reach under models that didn't see them, within the
    bounds; infinite if there are no such texts.  Texts without a mark have no say, as they may hold residue that no pattern knows."""
    return float(np.clip(np.quantile(scores, 1 - kept), LEAST_CUT, MOST_CUT)) if len(scores) else math.inf


def _fit_windows(
    texts: list[list[tuple[list[str], str]]], window: int = 8, rounds: int = 4, unlabelled_weight: float = 0.25, sure: float = 0.99, smoothing: float = 1000.0, rare: int = 2, company: float = 0.4
) -> ResidueModel:
    """Fit on a sample of texts: trusted windows are positive, the others unlabelled.

    The expectation step gives every unlabelled window its chance of being residue.  For the
    positive class only chances of at least ``sure`` count, by ``unlabelled_weight``, and the prior stays
    that of the trusted windows; else the two classes drift apart into any two kinds of text.
    Words in fewer than ``rare`` texts and in no trusted window, mostly names, count together as one
    unknown word, which never speaks for residue.
    """
    # One entry per word of the sample: its number, its text and passage, and whether it is marked.
    number: dict[str, int] = {}
    flat = [number.setdefault(w, len(number)) for told in texts for words, _ in told for w in words]
    if not flat:
        return ResidueModel({}, {}, -1.0, -1e9, window)
    word = np.array(flat)
    on = np.frombuffer("".join(m for told in texts for _, m in told).encode(), np.uint8) == ord("1")
    length = np.array([len(words) for told in texts for words, _ in told])
    passage = np.repeat(np.arange(len(length)), length)
    beside = np.bincount(passage, on)[passage] > 0
    text = np.repeat(np.repeat(np.arange(len(texts)), [len(told) for told in texts]), length)

    # Words and pairs that count: met in enough texts, or marked.
    side = passage[1:] == passage[:-1]
    met, pair = np.unique(word[:-1] * len(number) + word[1:], return_inverse=True)

    def counted(what: np.ndarray, where: np.ndarray, mark: np.ndarray, size: int) -> np.ndarray:
        spread_over = np.bincount(np.unique(where * size + what) % size, minlength=size)
        return (spread_over >= rare) | (np.bincount(what[mark], minlength=size) > 0)

    word_kept = counted(word, text, on, len(number))
    pair_kept = counted(pair[side], text[1:][side], (on[1:] & on[:-1])[side], len(met))
    unknown = int(word_kept.sum())
    size = unknown + 1 + int(pair_kept.sum())
    word_at = np.where(word_kept, np.cumsum(word_kept) - 1, unknown)
    pair_at = np.where(pair_kept, unknown + np.cumsum(pair_kept), -1)

    # Windows lie side by side, cut where marked and unmarked words meet, so that a window is of one kind.
    begins = np.ones(len(word), bool)
    begins[1:] = ~side | (on[1:] != on[:-1])
    start = np.maximum.accumulate(np.where(begins, np.arange(len(word)), 0))
    cut = (np.arange(len(word)) - start) % window == 0
    own = np.cumsum(cut) - 1
    k = int(own[-1]) + 1
    inside = (own[1:] == own[:-1]) & (pair_at[pair] >= 0)
    feature = np.concatenate([word_at[word], pair_at[pair][inside]])
    where = np.concatenate([own, own[1:][inside]])
    positive, beside = on[cut], (beside & ~on)[cut]
    if not positive.any():
        return ResidueModel({}, {}, -1.0, -1e9, window)
    # A window that a text repeats counts once, so that one long text of a few words can't outweigh all others.
    place = np.arange(len(word)) - np.flatnonzero(cut)[own]
    sign = np.zeros(k, np.uint64)
    rng = np.random.default_rng(1)
    np.add.at(sign, own, rng.integers(1, 1 << 63, len(number), np.uint64)[word] * rng.integers(1, 1 << 63, window, np.uint64)[place])
    once = np.zeros(k, bool)
    once[np.unique(np.stack([text[cut].astype(np.uint64), sign]), axis=1, return_index=True)[1]] = True
    prior = math.log((positive & once).sum() / max((~positive & once).sum(), 1))

    # Both classes are smoothed towards the words' frequency in all windows; a flat prior would make rare words speak for the smaller class.
    common = np.bincount(feature, once[where], minlength=size) + 1e-3
    common /= common.sum()
    # To begin with, a window in one passage with a trusted one may be either if its words keep to texts with trusted marks; all
    # others are taken for ordinary.  Without that condition whatever stands beside residue by chance, such as
    # vandals' cries, would be drawn in and draw its like in after it.
    pairs_of = np.unique(text[cut][where] * size + feature)
    has_mark = np.bincount(text, on, minlength=len(texts)) > 0
    spread_over = np.bincount(pairs_of % size, minlength=size)
    keeps_to = np.bincount(pairs_of % size, has_mark[pairs_of // size], minlength=size) / (spread_over + 2)
    kept_to = np.bincount(where, keeps_to[feature], minlength=k) / np.bincount(where, minlength=k)
    chance = np.where(positive, 1.0, np.where(beside & (kept_to >= company), 0.5, 0.0))
    for turn in range(rounds):
        counts = chance >= (sure if turn else 0.5)
        gain = np.where(positive, 1.0, np.where(counts, chance * unlabelled_weight, 0.0)) * once
        yes = np.bincount(feature, gain[where], minlength=size)
        no = np.bincount(feature, (np.where(positive, 0.0, 1 - chance) * once)[where], minlength=size)
        odds = np.log((yes + smoothing * common) / (yes.sum() + smoothing)) - np.log((no + smoothing * common) / (no.sum() + smoothing))
        odds[unknown] = min(odds[unknown], 0.0)
        total = np.bincount(where, odds[feature], minlength=k) + prior
        chance = np.where(positive, 1.0, 1 / (1 + np.exp(-np.clip(total, -30, 30))))
    names = list(number)
    following = {}
    for i in np.flatnonzero(pair_kept):
        first, second = divmod(int(met[i]), len(number))
        if word_kept[first] and word_kept[second]:
            following[names[first], names[second]] = float(odds[pair_at[i]])
    kept = {names[i]: float(odds[word_at[i]]) for i in np.flatnonzero(word_kept)}
    return ResidueModel(kept, following, float(odds[unknown]), prior, window)


def total_chars(documents: DataFrame, text: str) -> int:
    return documents.agg(F.sum(F.length(text).cast("bigint"))).first()[0] or 0


def sample_below(total: int, wanted: int) -> int:
    """The signed 64-bit hash below which a row is in the sample: the share ``wanted`` / ``total`` of all hashes."""
    return (wanted << 64) // total - (1 << 63)


def fit_on(documents: DataFrame, text: str = "text", key: str = "doc_id", fit_chars: int = 6_000_000) -> ResidueModel:
    """Fit on a bounded sample: documents whose hash of key and text falls below the share that makes ``fit_chars``
    characters.  Each task stops after its part of twice as many, so that repeated rows can't fill the driver.

    Texts longer than ``fit_chars`` aren't fitted on, but scored like all others.  Without any trusted mark in the sample the
    model finds nothing.  This is the only sample; it feeds the classifier and nothing else.  The executors read its
    texts and send words and marks, about as long as the texts, to the driver.
    """
    total = total_chars(documents, text)
    picked = documents.where((F.length(text) > 0) & (F.length(text) <= fit_chars))
    if total > fit_chars:
        picked = picked.where(F.xxhash64(key, text) < F.lit(sample_below(total, fit_chars)).cast("bigint"))
    tasks = documents.sparkSession.sparkContext.defaultParallelism

    @F.pandas_udf("array<struct<words:string, marks:string>>")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        seen = 0
        for s in batches:
            out = []
            for t in s:
                room = seen < 2 * fit_chars / tasks
                seen += len(t) if room else 0
                out.append([{"words": "\t".join(w), "marks": m} for w, m in marked_pieces(t)] if room else [])
            yield pd.Series(out)

    sample = picked.select(text).repartition(tasks)
    told = sample.select(read(F.col(text)).alias("r")).collect()
    return fit_marked([[(p.words.split("\t"), p.marks) for p in r[0]] for r in told])


def residue_scores(documents: DataFrame, model: ResidueModel, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, ``score`` (log odds of the best window of words, null if none is more likely residue than not) and
    ``found``: whether it reaches the model's cut.

    Null and empty texts, and texts of code and quotations only, score null and aren't found.
    """
    sent = documents.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = sent.value
        for s in batches:
            best = m.scores(s)
            yield pd.Series(best).mask(best <= 0)

    scored = spread(documents.select(key, text)).select(key, score(F.col(text)).alias("score"))
    return scored.select(key, "score", F.coalesce(F.col("score") >= model.cut, F.lit(False)).alias("found"))


def find_residue(documents: DataFrame, text: str = "text", key: str = "doc_id", fit_chars: int = 6_000_000) -> DataFrame:
    """Keys of the documents with residue, as the classifier decides; repeated rows come repeatedly, null and empty texts never."""
    model = fit_on(documents, text, key, fit_chars)
    return residue_scores(documents, model, text, key).where("found").select(key)
