"""Broken question and answer pairs.

``classify(question, answer)`` gives one defect type or None:

* ``empty``: missing, null, or nothing but blanks, marks or a placeholder;
* ``copied_question``: greedy string tiling covers the answer with the question;
* ``refusal``: every sentence is derived from the refusal or the courtesy grammar;
* ``other_language``: script and function words name another language;
* ``truncated``: a pushdown parser of fences, markup, brackets, quotations, lists
  and sentences has something open when the text ends.

What the payload says of its grounding is no evidence of a defect (refusals say
that they are grounded, too); ``defect_counts`` reports it by defect.

Defined cases: a non-string scalar answer is read as its JSON text, an empty
list or object is empty, other containers are sound values; without a readable
question only the tests on the answer alone apply. A payload that is no JSON
object, or nested beyond what the parser takes, gives no row."""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFECTS = ("empty", "truncated", "refusal", "copied_question", "other_language")

# Placeholders, lower case, without marks around them.
PLACEHOLDERS = frozenset(
    """none|null|nil|nan|na|n/a|n.a|tbd|todo|tba|undefined|blank|empty|missing|pending|placeholder|answer|response
    |no answer|no response|not available|not applicable|not provided|no data|your answer here|insert answer here
    |to be determined|to be done|lorem ipsum|xxx|string|unknown|unanswered|keine antwort|keine angabe|leer
    |sin respuesta|vacío|ninguna|pas de réponse|vide|aucune""".replace("\n", "").replace("    ", "").split("|")
)

# Function words that separate the languages of the logs.
FUNCTION_WORDS = {
    "en": "the of and to is in that it for as by which under with within who what does when why how has be not or may must shall on at from this",
    "de": "der die das und ist in den dem des ein eine einer nicht von zu mit auf wird durch weil nach über wer wann worauf ob für als auch sich im am bei muss darf so dass wie zur zum",
    "fr": "le la les et est de des du un une que qui dans par pour sur ne pas au aux cette il elle sont quand quoi dès avant après car d l c'est n sa son ses ou à",
    "es": "el la los las y es de del un una que en por para con no se su al como lo quién cuándo qué sobre esa ese antes porque según sus o",
    "it": "il lo gli e è di del della un una che in per con non si al come della nel sono",
    "pt": "o a os as e é do da dos das um uma que em por para com não se ao como na no são",
    "nl": "de het een en is van in dat op te met voor niet door wordt wie wanneer bij aan als ook",
}
FUNCTION_WORDS = {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items()}

WORD = re.compile(r"[^\W\d_]+", re.UNICODE)
INVISIBLE = dict.fromkeys([*range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), 0xFEFF, 0xAD], None)


def visible(text: str) -> str:
    return text.translate(INVISIBLE).strip()


# ---------------------------------------------------------------- empty

def is_empty(text: str) -> bool:
    core = visible(text)
    if not any(c.isalnum() for c in core):
        return True
    bare = core.strip(" \t\r\n.,;:!?…-–—_*#<>()[]{}\"'«»“”„`|/\\").lower()
    return " ".join(bare.replace("_", " ").split()) in PLACEHOLDERS


# ---------------------------------------------------------------- copied question

LEAD_IN = re.compile(
    r"^\W*(?:(?:question|answer|frage|antwort|pregunta|respuesta|réponse|q|a|you asked|your question(?: was| is)?|sie fragten|ihre frage(?: war| lautet)?"
    r"|vous avez demandé|vous demandez|votre question|usted preguntó|ha preguntado|preguntó|su pregunta)\s*[:\-–—])\s*",
    re.IGNORECASE,
)


def words(text: str) -> list[str]:
    return [w.lower() for w in re.findall(r"\w+", unicodedata.normalize("NFKC", text))]


def tiles(a: list[str], b: list[str], least: int = 2) -> tuple[list[bool], list[bool]]:
    """Greedy string tiling: marks of the words of ``a`` and ``b`` that lie in common
    runs of at least ``least`` words, the longest runs first. Maximal common runs
    are found once; what an earlier tile leaves of one goes back into the queue."""
    in_a, in_b = [False] * len(a), [False] * len(b)
    places: dict[str, list[int]] = {}
    for j, w in enumerate(b):
        places.setdefault(w, []).append(j)
    queue: list[tuple[int, int, int]] = []
    for i, w in enumerate(a):
        for j in places.get(w, ()):
            if i and j and a[i - 1] == b[j - 1]:
                continue
            n = 1
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            if n >= least:
                queue.append((-n, i, j))
    heapq.heapify(queue)
    while queue:
        n, i, j = heapq.heappop(queue)
        run = 0
        free = [not in_a[i + k] and not in_b[j + k] for k in range(-n)]
        if all(free):
            in_a[i : i - n] = in_b[j : j - n] = [True] * -n
            continue
        for k, is_free in enumerate([*free, False]):
            if is_free:
                run += 1
                continue
            if run >= least:
                heapq.heappush(queue, (-run, i + k - run, j + k - run))
            run = 0
    return in_a, in_b


def without_lead_in(answer: str) -> str:
    while m := LEAD_IN.match(answer):
        answer = answer[m.end() :]
    return answer


def copies_question(question: str, answer: str) -> bool:
    """Whether the answer is the question, once or several times, with at most a
    fifth of other words. Words the question lacks are never covered, so they rule
    most answers out before any tile is laid."""
    q, a = words(question), words(without_lead_in(answer))
    known, most = set(q), max(1, 0.2 * len(a))
    if len(q) < 2 or not a or sum(w not in known for w in a) > most or len(known.intersection(a)) < 0.5 * len(known):
        return False
    rest, least = a, 0.0
    while rest:  # a question may be given back more than once
        in_rest, in_q = tiles(rest, q)
        if not any(in_rest):
            break
        least = max(least, sum(in_q) / len(q))
        rest = [w for w, used in zip(rest, in_rest) if not used]
    if rest and least >= 0.5:  # single words moved within the question
        rest = [w for w in rest if w not in known]
    return least >= 0.6 and len(rest) <= most


# ---------------------------------------------------------------- refusal

# The refusal grammar. Nonterminals stand in braces in the productions;
# a sentence that holds a derivation of one is a refusal.
NONTERMINALS = {
    "self": r"(?:i|we)",
    "cannot": r"(?:cannot|can't|can not|could not|couldn't|unable|not able|won't|will not|must decline|decline|don't have|do not have|have no|don't know|do not know|am not (?:in a position|permitted|allowed)|not permitted)",
    "unable": r"(?:cannot|can't|unable to|not able to)",
    "reply": r"(?:answer|help|assist|comment|discuss|say|tell|provide|respond|comply)",
    "source": r"(?:ontology|graph|system|agent|assistant|model|corpus|record|data)",
    "lacks": r"(?:does not|doesn't|do not) (?:contain|hold|have|provide|include|know)",
    "matter": r"(?:enough|information|answer|data|anything|sufficient)",
    "machine": r"(?:agent|assistant|model)",
    "ich": r"(?:ich|wir)",
    "nicht": r"(?:nicht|keine?n?)",
    "quelle": r"(?:ontologie|graph|system)",
    "graphe": r"(?:ontologie|graphe|système)",
}
ACTS = {
    "en": [
        r"\b{self}\b.{0,40}\b{cannot}\b", r"\b{unable} {reply}", r"\b(?:outside|beyond) (?:of )?(?:what|the scope|my)\b.*", r"\b(?:i'm|i am) (?:only|just) an? .*{machine}",
    ],
    "de": [
        r"\b{ich}\b.{0,60}\b(?:{nicht}|ablehnen|außerstande|unmöglich)\b", r"\b(?:kann|können|darf|möchte)\b.{0,20}\b{ich}\b.{0,60}\b(?:{nicht}|nichts)\b",
        r"\bmuss ich (?:ablehnen|passen)|\bhabe ich keine\b|\bnicht beantwort", r"\bist mir\b.{0,60}\b(?:nicht möglich|unmöglich|nicht erlaubt)\b",
    ],
    "fr": [
        r"\bje (?:ne|n')\b.{0,60}\b(?:pas|aucune?|rien|plus)\b", r"\bje (?:dois|préfère|suis) .{0,40}\b(?:refuser|décliner|ne pas|incapable|dans l'impossibilité)\b", r"\bil (?:m'est|est) impossible\b",
    ],
    "es": [
        r"\bno (?:puedo|podemos|dispongo|disponemos|tengo|tenemos|sé|me es posible|estoy (?:autorizad|en condiciones)|cuento)\b", r"\bdebo (?:negarme|rehusar|declinar|abstenerme)|\bme es imposible\b",
    ],
}
LACKS = {
    "en": [
        r"\bno answer (?:can|could|is|was)\b", r"\b{source}\b.{0,30}\b{lacks}\b.{0,40}\b{matter}", r"\bthere is (?:nothing|no (?:information|data|answer))\b",
        r"\b(?:not enough|no|insufficient) (?:information|data) (?:is|was|to|on|about|available)",
    ],
    "de": [r"\bliegen mir keine\b|\bmir liegen keine\b|\bkeine (?:daten|angaben|informationen|antwort)\b", r"\b{quelle}\b.{0,30}\b(?:enthält|hat|bietet)\b.{0,20}\b(?:keine|nicht genug|zu wenig)\b"],
    "fr": [r"\b(?:aucune (?:réponse|information|donnée)|pas assez d'informations?)\b", r"\b{graphe}\b.{0,30}\bne (?:contient|permet|dispose)\b.{0,30}\b(?:pas|aucune?)\b"],
    "es": [r"\b(?:no hay|ninguna?) (?:datos|información|respuesta)\b", r"\bno (?:contiene|tiene|ofrece)\b.{0,30}\b(?:información|datos|suficiente)"],
}


def derivations(grammar: dict[str, list[str]]) -> re.Pattern:
    """One matcher for all derivations of a grammar's productions."""
    expand = lambda production: re.sub(r"\{([a-z]+)\}", lambda m: NONTERMINALS[m[1]], production)
    return re.compile("|".join(expand(p) for productions in grammar.values() for p in productions), re.IGNORECASE)


REFUSES, UNKNOWN = derivations(ACTS), derivations(LACKS)
COURTESY = re.compile(
    r"^(?:(?:i'?m|i am|we'?re|we are)?\s*(?:so |very |truly )?(?:sorry|afraid)\b.{0,60}|(?:(?:i|we|my|our) )?(?:\w+ )?apolog\w+.{0,40}|unfortunately.{0,20}|please\b.*|(?:would|do|could|can|may|is there|what|how)\b.*\byou\b.*|(?:would you|is there anything).*|try again\b.*|thank.*"
    r"|feel free\b.*|let me know\b.*|ask (?:me )?.*|consult\b.*|contact\b.*|you may .*|rephrase\b.*"
    r"|(?:es )?tut mir leid.{0,40}|leider.{0,20}|entschuldig\w*.{0,40}|bitte\b.*|(?:möchten|wollen|können|darf|kann) (?:sie|ich|wir)\b.*|versuchen sie\b.*|wenden sie\b.*"
    r"|(?:je suis )?désolée?.{0,40}|malheureusement.{0,20}|veuillez\b.*|(?:souhaitez|voulez|pouvez|puis)[- ](?:vous|je)\b.*|essayez\b.*|merci.*|adressez-vous\b.*|reformulez\b.*|consultez\b.*"
    r"|lo (?:siento|lamento).{0,40}|lamentablemente.{0,20}|por desgracia.{0,20}|disculp\w+.{0,40}|perdon\w*.{0,40}|por favor\b.*|¿?\s*(?:quiere|desea|puedo|podría|quisiera|le gustaría)\b.*|consulte\b.*|intente\b.*|inténtelo\b.*|pruebe\b.*|reformule\b.*|diríjase\b.*|sorry)[\s.!?…]*$",
    re.IGNORECASE,
)
CONTENT_TURN = re.compile(r"\b(?:but|however|yet|although)\b(?!,? (?:i|we|that|no|the (?:working )?(?:ontology|graph)|there)\b)|\bbut (?:it|the \w+) (?:does|do|is|are|has)\b|\b(?:aber|jedoch|mais|pero)\b", re.IGNORECASE)
SENTENCE_END = re.compile(r"(?<=[.!?…])\s+|\s+[—–]\s+|\n+|;\s+")


def refuses(answer: str) -> bool:
    """Whether every sentence is a refusal or a courtesy, and one is a refusal."""
    declines = lambda s: bool(REFUSES.search(s) or UNKNOWN.search(s))
    declined = False
    for sentence in SENTENCE_END.split(without_lead_in(answer)):
        s = visible(sentence).lstrip("—–-•*> \"'«“").replace("’", "'")
        if not any(c.isalnum() for c in s):
            continue
        if COURTESY.match(s):
            declined = declined or declines(s) and not s.endswith("?")
        elif declines(s):
            if CONTENT_TURN.search(s) and not re.match(r"^\W*(?:i'?m|i am|sorry|unfortunately|leider|désolé|lo siento|malheureusement|apolog|my)", s, re.IGNORECASE):
                return False
            declined = True
        else:
            return False
    return declined


# ---------------------------------------------------------------- language

def scripts(text: str) -> dict[str, int]:
    found: dict[str, int] = {}
    for c in text:
        if c.isalpha():
            n = ord(c)
            name = (
                "latin" if n < 0x250 or 0x1E00 <= n < 0x1F00 or 0xFF00 <= n < 0xFF60
                else "greek" if n < 0x400 or 0x1F00 <= n < 0x2000
                else "cyrillic" if n < 0x530
                else "hebrew" if 0x590 <= n < 0x600
                else "arabic" if 0x600 <= n < 0x780
                else "kana" if 0x3040 <= n < 0x3100
                else "han" if 0x3400 <= n < 0xA000
                else "hangul" if 0xAC00 <= n < 0xD7B0
                else unicodedata.name(c, "other").split()[0].lower()
            )
            found[name] = found.get(name, 0) + 1
    return found


def language(text: str) -> tuple[str, dict[str, int], int]:
    """Best language (``""`` if unknown), its function-word counts, words."""
    letters = scripts(text)
    if letters:
        top = max(letters, key=letters.get)
        if top != "latin" and letters[top] >= 0.6 * sum(letters.values()):
            return top, {top: 99}, len(text.split())
    seen = [w.lower() for w in WORD.findall(text.replace("’", "'"))]
    counts = {k: sum(w in v for w in seen) for k, v in FUNCTION_WORDS.items()}
    best = max(counts, key=counts.get)
    ranked = sorted(counts.values(), reverse=True)
    if ranked[0] < 2 or ranked[0] == ranked[1]:
        best = ""
    return best, counts, len(seen)


def other_language(question: str, answer: str) -> bool:
    bare = without_lead_in(answer)
    q = question.strip().rstrip("?!. ")
    if q and bare.strip().lower().startswith(q.lower()):
        bare = bare.strip()[len(q) :].lstrip("?!. \n")
    spoken, _, _ = language(question)
    given, counts, n = language(bare)
    if not spoken or not given or spoken == given:
        return False
    own = counts.get(spoken, 0)
    return counts[given] >= max(2, 0.15 * n if n < 40 else 4) and counts[given] >= 1.5 * own + 1


# ---------------------------------------------------------------- truncation

OPENERS = {"(": ")", "[": "]", "{": "}", "«": "»", "“": "”", "„": "“"}
CLOSERS = {v: k for k, v in OPENERS.items()} | {"”": "“"}
EMPTY_TAGS = frozenset(("br", "hr", "img", "input", "meta", "link"))
LABEL = r"[^\W\d_](?:\w|[-:.#/])*"
ITEM = re.compile(rf"^(?:[-*•]\s+|\(?\d+[.)]\s*)?{LABEL}(?:\s+\([\w: ]+\))?$")
# Abbreviations after which a sentence goes on.
ABBREVIATIONS = frozenset("sec art no nos para paras cf e.g i.e vs abs ziff bzw vgl p pp fig reg núm n nr z.b u.a ca".split())
NUMBERS = {w: n for ws, n in (("two zwei deux dos", 2), ("three drei trois tres", 3), ("four vier quatre cuatro", 4), ("five fünf cinq cinco", 5), ("six sechs seis", 6)) for w in ws.split()}
TOKENS = re.compile(
    r"(?P<fence>```)|</?(?P<tag>[a-zA-Z][\w-]*)(?:\s[^<>]*)?/?>|(?P<iri>(?:https?://|urn:)\S*[\w/])"
    r"|(?P<announce>\b(?:" + "|".join(NUMBERS) + r")\s+[\w ]{3,30}:(?=\s*\(?1[.)]))|\((?P<mark>\d+)\)|(?<!\S)(?P<number>\d+)[.)](?=\s)"
    r"|(?P<dots>\.{2,}|…|�)|(?P<stop>[.!?。！？؟;·](?:\[\w+\])?)|(?P<pause>[-–—,:/&])|(?P<quote>['’\"])|(?P<open>[(\[{«„])|(?P<close>[)\]}»”])|(?P<both>“)"
    r"|(?P<word>\w+(?:\.\w+)*)|(?P<other>[^\s*_`])",
    re.IGNORECASE,
)


class Pushdown:
    """The parser: a stack of what is open, each with whether a sentence is under way
    in it and whether that hangs on a pause. ``last`` is the kind of the last token."""

    def __init__(self, text: str) -> None:
        self.stack: list[list] = [["text", False, False]]  # (what, sentence, hanging)
        self.lists: list[list[int]] = []  # (announced, reached) of numbered lists
        self.last, self.word = "", ""
        for m in TOKENS.finditer(text):
            kind, token = m.lastgroup, m[0]
            if self.stack[-1][0] == "```":
                if kind == "fence":
                    self.pop("```")
                    self.last = "fence"
                continue
            if kind == "fence":
                self.stack.append(["```", False, False])
            elif kind == "tag":
                self.markup(token, m["tag"].lower())
            elif kind in ("quote", "open", "close", "both"):
                self.bracket(token, text, m.start())
            elif kind == "announce":
                self.lists.append([NUMBERS[token.split()[0].lower()], 0])
                self.stack[-1][1:] = [True, True]
            elif kind in ("mark", "number"):
                for held in self.lists:
                    held[1] = max(held[1], int(m[kind]))
                self.stack[-1][1:] = [True, kind == "mark"]
            elif kind == "stop":
                if token[0] == "." and self.last == "word" and self.word in ABBREVIATIONS:
                    kind = "abbreviation"
                else:
                    self.stack[-1][1:] = [False, False]
            elif kind in ("pause", "dots"):
                self.stack[-1][2] = True
            else:
                self.stack[-1][1:] = [True, False]
                self.word = token.lower()
            self.last = kind

    def pop(self, what: str) -> None:
        """Closes the last of its kind, and what was opened in it."""
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k][0] == what:
                ended = not self.stack[k][1]
                del self.stack[k:]
                # A full stop within the quotation or bracket may end the sentence around it.
                self.stack[-1][1:] = [self.stack[-1][1] and not ended or not ended, False]
                return

    def markup(self, token: str, tag: str) -> None:
        if token[1] == "/":
            self.pop(f"<{tag}>")
        elif token[-2] != "/" and tag not in EMPTY_TAGS:
            self.stack.append([f"<{tag}>", False, False])

    def bracket(self, c: str, text: str, i: int) -> None:
        held = [frame[0] for frame in self.stack]
        if c in "'’":
            before, after = text[i - 1 : i] or " ", text[i + 1 : i + 2] or " "
            if before.isspace() or before in "([«“":
                if after.isalnum() and c == "'":
                    self.stack.append(["'", False, False])
            elif not after.isalnum():
                self.pop("'")
        elif c == '"':
            if c in held:
                self.pop(c)
            else:
                self.stack.append([c, False, False])
        elif c in CLOSERS and CLOSERS[c] in held:
            self.pop(CLOSERS[c])
        elif c in OPENERS:
            self.stack.append([c, False, False])

    def left(self) -> str:
        """What is open at the end: a container, a list, a clause, a sentence; or "". """
        if len(self.stack) > 1:
            return self.stack[-1][0]
        if any(reached < announced for announced, reached in self.lists):
            return "list"
        if self.stack[0][2] or self.last in ("pause", "dots", "abbreviation", "open"):
            return "clause"
        if self.stack[0][1] and self.last not in ("iri", "fence", "tag", "close"):
            return "sentence"
        return ""


def is_list(text: str) -> bool:
    """A bare class label, or a list of nothing but labels."""
    parts = [p.strip() for line in text.split("\n") for p in re.split(r"[,;|]\s*", line) if p.strip()]
    return bool(parts) and all(ITEM.match(p) for p in parts) and (len(parts) > 1 or len(text.split()) <= 2) and any(re.search(r"[a-z][A-Z]|_|:|\)$|\d", p) or len(p.split()) == 1 and p[:1].isupper() for p in parts)


def truncated(answer: str) -> str:
    """What the parser has open at the end; a list of labels ends without a mark."""
    bare = answer.translate(INVISIBLE).strip()
    left = Pushdown(bare).left() if bare else ""
    return "" if left == "sentence" and is_list(bare) else left


def as_text(value: object) -> str | None:
    """None for what holds no answer; containers and numbers as JSON text."""
    if value is None or value == [] or value == {}:
        return None
    if isinstance(value, str):
        return value
    if isinstance(value, list) and all(isinstance(v, str) for v in value):
        return ", ".join(value)
    return json.dumps(value, ensure_ascii=False)


def classify(question: object, answer: object) -> str | None:
    q, a = as_text(question) or "", as_text(answer)
    if a is None or is_empty(a):
        return "empty"
    if q and copies_question(q, a):
        return "copied_question"
    if refuses(a):
        return "refusal"
    if q and other_language(q, a):
        return "other_language"
    if isinstance(answer, str) and truncated(a):
        return "truncated"
    return None


def payload_defect(payload: str | None) -> tuple[bool, str | None, bool]:
    """Whether the payload is a record, its defect, and whether it says it is grounded."""
    try:
        value = json.loads(payload) if payload is not None else None
        value = json.loads(value) if isinstance(value, str) else value
    except (ValueError, RecursionError):
        return False, None, False
    if not isinstance(value, dict):
        return False, None, False
    return True, classify(value.get("question"), value.get("answer")), value.get("grounded") in (True, "true")


def _judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for event_id, payload in zip(batch["event_id"].tolist(), batch["payload"].tolist()):
            valid, defect, grounded = payload_defect(payload)
            if valid:
                rows.append((event_id, defect, grounded))
        frame = pd.DataFrame(rows, columns=["event_id", "defect", "grounded"])
        yield frame.astype({"defect": object, "grounded": bool})


def judged_pairs(session_log: DataFrame) -> DataFrame:
    """(event_id, defect or null, grounded), one row per query event with a valid payload.

    The texts are judged where they are read; only ids and verdicts are shuffled
    to count repeated rows once. Rows without an event_id are no records."""
    rows = session_log.where((F.col("event_type") == "query") & F.col("event_id").isNotNull()).select("event_id", "payload")
    judged = rows.mapInPandas(_judge, "event_id BIGINT, defect STRING, grounded BOOLEAN")
    return judged.groupBy("event_id").agg(F.min("defect").alias("defect"), F.bool_or("grounded").alias("grounded"))


def broken_pairs(session_log: DataFrame) -> DataFrame:
    return judged_pairs(session_log).where(F.col("defect").isNotNull()).select("event_id", "defect")


def defect_counts(session_log: DataFrame) -> DataFrame:
    """Rows, rows that say they are grounded, and share per defect type; sound pairs as
    ``sound``. A defective pair that says it is grounded contradicts itself."""
    counts = judged_pairs(session_log).groupBy(F.coalesce("defect", F.lit("sound")).alias("defect")).agg(F.count("*").alias("pairs"), F.count_if("grounded").alias("grounded"))
    total = counts.agg(F.sum("pairs")).scalar()
    return counts.select("defect", "pairs", "grounded", F.round(F.col("pairs") / total, 6).alias("share"))
