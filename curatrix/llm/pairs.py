"""Broken prompt and response pairs: a multi-label linear classifier on hashed n-grams and pair features.

It is trained on pairs of the data itself: answers that look whole serve as negatives and, truncated, copied, swapped
for an answer in another language, refused or emptied, as positives. What the first fits find among the negatives is
left out of, and learnt from in, the next. The synthetic refusals come from a small grammar of five languages that was
written without the tables. Thresholds are calibrated on held-out pairs.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.llm.languages import tongue

DEFECTS = ("empty", "truncated", "refusal", "copy", "wrong_language")
SPACE, NAMED = 1 << 18, 1 << 12
#: Share of longer answers with a first person at their end that are taken to decline there.
LATE = 0.02
#: Fits one after the other, each but the last short.
TURNS = 5
#: Hashed features in all, the first of them for the named ones. Length of the n-grams of a pair together, against 1 for each pair feature.
GRAMS = 2.0
START, MESSAGE, CHANNEL = "<|start|>", "<|message|>", "<|channel|>"
STOP = re.compile(r"<\|(?:end|call|return|start)\|>")

# Names of languages in five languages.
ASKED = {
    "en": r"\benglish\b|\benglisch\b|\binglés\b|\banglais\b|英[语文]",
    "de": r"\bgerman\b|\bdeutsch\b|\balemán\b|\ballemand\b|德[语文]",
    "es": r"\bspanish\b|\bspanisch\b|\bespañol\b|\bcastellano\b|\bespagnol\b|西班牙[语文]",
    "fr": r"\bfrench\b|\bfranzösisch\b|\bfrancés\b|\bfrançais\b|法[语文]",
    "zh": r"\bchinese\b|\bchinesisch\b|\bchino\b|\bchinois\b|中文|汉语",
}
# A grammar of declining: for each language the ways to open, then patterns whose {slots} are filled from the lists below.
OPENINGS = {
    "en": ["", "", "I'm sorry, but ", "I am sorry. ", "Sorry, ", "I apologize, ", "My apologies, but ", "Regrettably, ", "I'm afraid ", "As an AI model, ", "Thank you for your message, but ", "I understand the interest, however "],
    "de": ["", "", "Es tut mir leid, aber ", "Tut mir leid, ", "Leider ", "Ich bedaure, ", "Ich bitte um Verständnis: ", "Als KI-Modell "],
    "es": ["", "", "Lo siento, ", "Perdona, pero ", "Me temo que ", "Por desgracia, ", "Como modelo de IA, ", "Lamento decir que "],
    "fr": ["", "", "Désolé, ", "Je regrette, mais ", "Toutes mes excuses, ", "Hélas, ", "En tant qu'IA, ", "Je crains que non : "],
    "zh": ["", "", "不好意思,", "非常抱歉,", "很遗憾,", "作为人工智能,", "请谅解,"],
}
PATTERNS = {
    "en": ["I {cannot} {do} {it}", "I {cannot} {do} {it}", "I'm {unable} to {do} {it}", "I {refuse} to {do} {it}", "{it2} is {beyond} {limits}", "{limits2} {forbid} me from {doing} {it}", "it {isnt} for me to {do} {it}", "I have no {means} to {do} {it}", "no {reply} on {it} {comes} from me", "please do not ask me to {do} {it}"],
    "de": ["ich {kann} {es} nicht {tun}", "ich {kann} {dir} {dazu} nicht {helfen}", "{es} {kann} ich nicht {tun}", "{dazu} {gebe} ich keine {antwort}", "ich {lehne} es ab, {es} zu {tun}", "es ist mir nicht {erlaubt}, {es} zu {tun}", "{regeln} {verbieten} mir, {es} zu {tun}", "das {liegt} außerhalb {meiner}"],
    "es": ["no {puedo} {hacer} {eso}", "no {puedo} {hacer} {eso}", "me niego a {hacer} {eso}", "no me está {permitido} {hacer} {eso}", "{reglas} me {impiden} {hacer} {eso}", "{eso2} queda fuera de {limites}", "no daré {respuesta} sobre {eso2}", "tengo que {rechazar} {eso2}"],
    "fr": ["je ne {peux} pas {faire} {cela}", "je ne {peux} pas {faire} {cela}", "je refuse de {faire} {cela}", "il ne m'est pas {permis} de {faire} {cela}", "{regles} m'{interdisent} de {faire} {cela}", "{cela2} sort de {limites}", "je ne donnerai aucune {reponse} sur {cela2}", "je me dois de {decliner}"],
    "zh": ["我{buneng}{zuo}{zhe}", "我{buneng}{zuo}{zhe}", "{zhe}{chaochu}", "我拒绝{zuo}{zhe}", "{guiding}我{zuo}{zhe}", "对于{zhe},我{buneng}{zuo}"],
}
SLOTS = {
    "cannot": ["can't", "cannot", "can not", "won't", "will not", "may not", "am not going to", "would prefer not to", "don't feel comfortable to", "would rather not", "do not wish to", "must not"],
    "unable": ["unable", "not able", "not allowed", "not permitted", "not willing", "not in a position", "not authorised", "not prepared", "forbidden"],
    "refuse": ["refuse", "decline", "must decline", "have to decline", "choose not", "am required to decline", "need to refuse"],
    "do": ["help with", "assist with", "answer", "respond to", "reply to", "comment on", "discuss", "talk about", "write about", "advise on", "give information on", "provide details about", "speak to", "take on", "continue with", "complete", "support", "fulfil", "handle", "share anything about"],
    "doing": ["helping with", "answering", "responding to", "commenting on", "discussing", "talking about", "giving information on", "providing details about", "sharing anything about", "taking part in"],
    "it": ["that", "this", "it", "this question", "that question", "this request", "your request", "this topic", "this matter", "such a task", "questions like this", "what you ask", "the subject", "these things", "any of this"],
    "it2": ["This", "That", "Your request", "This topic", "This question", "The matter", "What you are asking for"],
    "beyond": ["beyond", "outside", "outside of", "not within", "against", "in conflict with", "not part of"],
    "limits": ["my abilities", "my guidelines", "what I am able to do", "what I can talk about", "the rules I follow", "my policy", "the scope of my work", "my remit", "what I'm permitted to cover"],
    "limits2": ["My guidelines", "My rules", "My instructions", "Company policy", "Safety rules", "The terms of use"],
    "forbid": ["prevent", "keep", "stop", "bar", "prohibit"],
    "isnt": ["isn't possible", "is not appropriate", "would be inappropriate", "wouldn't be right", "is impossible", "is not allowed", "would be wrong", "isn't my place"],
    "means": ["way", "means", "permission", "right", "ability", "authority", "information"],
    "reply": ["answer", "reply", "comment", "help", "statement", "response"],
    "comes": ["will come", "can be expected", "is going to come", "may come"],
    "kann": ["kann", "darf", "will", "möchte", "werde"],
    "es": ["das", "diese Frage", "diese Anfrage", "dieses Thema", "so etwas", "Ihre Bitte", "deine Bitte", "diese Aufgabe"],
    "tun": ["beantworten", "besprechen", "behandeln", "erfüllen", "kommentieren", "bearbeiten", "erklären", "übernehmen", "diskutieren"],
    "dir": ["", "Ihnen", "dir", "euch"],
    "dazu": ["dazu", "hierzu", "darüber", "zu dieser Frage", "zu diesem Thema", "bei dieser Bitte", "in dieser Sache"],
    "helfen": ["helfen", "weiterhelfen", "antworten", "Auskunft geben", "etwas sagen", "Stellung nehmen", "schreiben"],
    "gebe": ["gebe", "habe", "erteile"], "antwort": ["Antwort", "Auskunft", "Hilfe", "Information", "Meinung"],
    "lehne": ["lehne"], "erlaubt": ["erlaubt", "möglich", "gestattet"], "regeln": ["Meine Richtlinien", "Meine Regeln", "Die Vorgaben"], "verbieten": ["verbieten", "untersagen"],
    "liegt": ["liegt", "fällt"], "meiner": ["meiner Möglichkeiten", "meiner Aufgaben", "dessen, was ich tun darf", "meiner Richtlinien"],
    "puedo": ["puedo", "quiero", "debo", "voy a", "soy capaz de", "pienso", "deseo"], "hacer": ["ayudar con", "responder a", "contestar", "comentar", "hablar de", "tratar", "escribir sobre", "dar información sobre", "opinar sobre", "seguir con"],
    "eso": ["eso", "esto", "esta pregunta", "esa solicitud", "este tema", "tu petición", "ese asunto", "lo que pides"], "eso2": ["eso", "esta solicitud", "este tema", "tu pregunta", "lo que pides"],
    "permitido": ["permitido", "autorizado"], "reglas": ["Mis normas", "Mis reglas", "Las políticas"], "impiden": ["impiden", "prohíben"], "limites": ["mis límites", "mis funciones", "lo que puedo hacer", "mis capacidades"], "respuesta": ["respuesta alguna", "ninguna respuesta", "información"], "rechazar": ["rechazar", "declinar"],
    "peux": ["peux", "veux", "dois", "vais", "souhaite", "saurais"], "faire": ["répondre à", "aider pour", "traiter", "commenter", "discuter de", "parler de", "écrire sur", "donner des informations sur", "poursuivre avec"],
    "cela": ["cela", "ça", "cette question", "cette demande", "ce sujet", "votre demande", "ce thème", "ce que vous demandez"], "cela2": ["cela", "cette demande", "ce sujet", "votre question"],
    "permis": ["permis", "possible", "autorisé"], "regles": ["Mes règles", "Mes consignes", "Les directives"], "interdisent": ["interdisent", "empêchent"], "limites_fr": ["mes limites"], "reponse": ["réponse", "information", "aide"], "decliner": ["refuser", "décliner", "m'abstenir"],
    "buneng": ["不能", "无法", "没办法", "不可以", "不愿意", "不应该", "不会"], "zuo": ["回答", "帮助处理", "讨论", "谈论", "评论", "提供", "解释", "完成", "说明", "答复"], "zhe": ["这个问题", "该请求", "这件事", "这个主题", "您的要求", "此类内容", "这方面的信息"], "chaochu": ["超出了我的能力范围", "不在我的职责之内", "违反我的准则", "不是我能做的"], "guiding": ["规定不允许", "准则禁止", "政策不允许"],
}
CLOSINGS = {
    "en": ["", "", "", " Let me know if something else comes up.", " A specialist would be a better choice.", " Try another source.", " Is there another matter?", " I have nothing to go on here."],
    "de": ["", "", " Gibt es eine andere Frage?", " Eine Fachkraft weiß hier mehr.", " Versuche es an anderer Stelle."],
    "es": ["", "", " ¿Tienes otra pregunta?", " Un especialista sabrá más.", " Busca otra fuente."],
    "fr": ["", "", " Avez-vous une autre question ?", " Un spécialiste en saura plus.", " Cherchez une autre source."],
    "zh": ["", "", "您还有其他问题吗?", "建议询问专家。"],
}
# What a long answer may begin with, before it answers or declines.
BEGINNINGS = {
    "en": ["Thank you for the question, which many readers have raised before in one form or another.", "Before going further it is worth recalling what the subject is about and why it matters to so many.", "There is a long history behind this, and several schools have written on it at length over the years.", "Much depends on the setting, on the time and on what is taken for granted at the outset.", "Let me first set out the background, since the terms are often used loosely."],
    "de": ["Vielen Dank für die Frage, die in dieser oder ähnlicher Form schon oft gestellt wurde.", "Zunächst lohnt ein Blick auf den Hintergrund, denn die Begriffe werden häufig ungenau gebraucht.", "Das Thema hat eine lange Geschichte, und mehrere Schulen haben ausführlich darüber geschrieben."],
    "es": ["Gracias por la pregunta, que muchos lectores han planteado antes de una forma u otra.", "Antes de seguir conviene recordar de qué trata el tema y por qué importa a tanta gente.", "Hay una larga historia detrás de todo esto, y varias escuelas han escrito mucho sobre ello."],
    "fr": ["Merci pour la question, que bien des lecteurs ont déjà posée sous une forme ou une autre.", "Avant d'aller plus loin, il convient de rappeler le contexte, car les termes sont souvent employés sans soin.", "Le sujet a une longue histoire, et plusieurs écoles ont beaucoup écrit à ce propos."],
    "zh": ["感谢您的提问,许多读者以前也以不同的形式提出过类似的疑问。", "在继续之前,值得先回顾一下这个主题的背景以及它为何对许多人重要。", "这个话题有着悠久的历史,多个学派多年来都有大量的论述。"],
}
# Words that stand for a missing value, first persons and negations (closed classes of words).
MISSING = ("none", "null", "nil", "nan", "n/a", "na", "empty", "missing", "undefined", "blank", "nothing", "no answer", "no response", "no content", "no output")
FIRST = frozenset("i i'm i'd i'll i've me my mine we our us ich mir mich mein meine meiner meinen wir uns yo mi mis mí me nos je j' moi mon ma mes nous 我 我们 本".split())
NOT = frozenset("not no none never neither nor cannot can't won't don't didn't isn't doesn't wouldn't couldn't shouldn't aren't without unable nicht nichts kein keine keinen keiner nie nein ohne weder nunca ni tampoco sin ningún ninguna ne n' pas non aucun aucune jamais sans 不 无 没 未 别 勿".split())
WORDS = re.compile(r"[一-鿿]|[^\W\d_一-鿿]+(?:['’][^\W\d_]+)?|\d+", re.UNICODE)
NAMES = {k: re.compile(v) for k, v in ASKED.items()}
ANY = re.compile("|".join(ASKED.values()))
COUNTED = re.compile(r"(?:^|\D)(\d{1,2}|two|three|four|five|six|seven|eight|nine|ten|zwei|drei|vier|fünf|sechs|sieben|acht|dos|tres|cuatro|cinco|seis|siete|ocho|deux|trois|quatre|cinq|sept|huit|[二两三四五六七八九十])\s*(?:points?|steps?|reasons?|things?|remarks?|parts?|items?|punkte\w*|schritte\w*|gründe\w*|puntos|pasos|razones|étapes|raisons|个要点|点|个步骤|条)")
NUMBERS = {w: i for ws in ("two three four five six seven eight nine ten", "zwei drei vier fünf sechs sieben acht", "dos tres cuatro cinco seis siete ocho", "deux trois quatre cinq six sept huit") for i, w in enumerate(ws.split(), 2)} | {w: i for i, w in enumerate("二三四五六七八九十", 2)} | {"两": 2}
ITEMS = re.compile(r"^\s*(?:\d{1,2}[.)、]|[-*•])\s*\S", re.M)
CODE = re.compile(r"\s*(?:theorem|lemma|def|import|from|class|select|function|example)\b", re.I)
OPTION = re.compile(r"^[A-H]\)", re.M)
BARE = re.compile(r"\d{1,2}[.)、]|[-*•]")
TERMINAL = frozenset(".!?。!?…")
RULE = re.compile(r"\s*\|[-:| ]+\|\s*$")
SENTENCE = re.compile(r"[.!?](?:\s+|$)|[。!?]")
SLOT = re.compile(r"\{(\w+)\}")


class Model(NamedTuple):
    weights: np.ndarray
    cuts: np.ndarray
    known: frozenset[str]
    #: The threshold for a refusal at the end of a longer answer.
    late: float = 0.0


def messages(text: str) -> Iterator[tuple[str, str | None, str]]:
    """(role, channel, content) of each message; a content without a closing tag ends at the next start or the end."""
    pos = text.find(START)
    while pos >= 0:
        at = text.find(MESSAGE, pos)
        if at < 0:
            return
        again = text.rfind(START, pos + 1, at)
        head = text[(again if again > pos else pos) + len(START) : at]
        begin = at + len(MESSAGE)
        stop = STOP.search(text, begin)
        end = stop.start() if stop else len(text)
        role, sep, channel = head.partition(CHANNEL)
        yield role.strip(), channel.strip() if sep else None, text[begin:end]
        pos = text.find(START, end)


def pairs(text: str) -> list[tuple[str, str]]:
    """(question, answer) of each user message, in order: all the assistant says without a channel or in channel final before the next."""
    out: list[tuple[str, list[str]]] = []
    for role, channel, content in messages(text):
        if role == "user":
            out.append((content, []))
        elif role == "assistant" and out and channel in (None, "", "final"):
            out[-1][1].append(content)
    return [(q, "\n".join(a)) for q, a in out]


def asked_for(question: str) -> list[str]:
    """Languages that a question in lower case names."""
    return [k for k, r in NAMES.items() if r.search(question)] if ANY.search(question) else []


_CODES: dict[str, int] = {}


def code(name: str) -> int:
    """The hash of a name; the names a task has met are kept (at most 200,000)."""
    k = _CODES.get(name)
    if k is None:
        if len(_CODES) > 200_000:
            _CODES.clear()
        k = _CODES[name] = zlib.crc32(name.encode())
    return k


def bucket(x: float, cuts: tuple[float, ...]) -> int:
    return sum(x >= c for c in cuts)


def near(words: list[str]) -> tuple[bool, bool]:
    """Whether a negation follows or precedes a first person within five words: anywhere, and in the last twenty."""
    here = [i for i, w in enumerate(words) if w in FIRST]
    if not here:
        return False, False
    no = [i for i, w in enumerate(words) if w in NOT or "n't" in w]
    met = [i for i in here if any(abs(i - j) <= 5 for j in no)]
    return bool(met), bool(met) and met[-1] >= len(words) - 20


def shape(question: str, answer: str, known: frozenset[str]) -> tuple[list[str], list[str]]:
    """(features of a pair by name, words of the answer); ``known`` are the words that answers hold whole."""
    a = answer.strip()
    asking, low = question.lower(), a.lower()
    qw, aw = WORDS.findall(asking), WORDS.findall(low)
    n = len(aw)
    size = bucket(n, (1, 2, 3, 5, 9, 15, 30, 60))
    out = [f"size{size}", f"chars{bucket(len(a), (1, 2, 4, 8, 16, 40, 100))}"]
    inner = low.strip(" \n\t()[]{}<>\"'`*_-.,:;!?/").strip()
    if not n or not inner or inner in MISSING:
        out.append("nothing")
    # the end
    fence, last = a.count("```"), a[-1:]
    lines = a.splitlines() or [""]
    tail = lines[-1].strip()
    kind = "stop" if last and last in TERMINAL else "letter" if last.isalpha() else "digit" if last.isdigit() else "other" + last
    code_ = fence > 0 or "\n  " in a or ":= by" in a or CODE.match(lines[0]) is not None
    table = tail.startswith("|")
    whole_end = kind == "stop" or (table and tail.endswith("|") and len(tail) > 1) or (code_ and (tail in ("sorry", "```") or tail.endswith((";", "}", ")")))) or (last != "" and last in "}]$" and "\\boxed" in a[-40:])
    opened = a.count("{") - a.count("}") if ")" in a and OPTION.search(a) else a.count("(") + a.count("[") + a.count("{") - a.count(")") - a.count("]") - a.count("}")
    odd = fence % 2 == 1
    math = (a.count("$") - a.count("\\$")) % 2 == 1
    rule = next((x.count("|") for x in reversed(lines) if RULE.match(x)), 0) if "|" in a else 0
    ragged = rule > 0 and tail.startswith("|") and tail.count("|") != rule
    short = n <= 3
    out += [f"end {kind}", f"end {kind} code{int(code_)}", f"whole{int(whole_end)} short{int(short)}", f"open{int(opened > 0)}", f"fence{int(odd)}", f"math{int(math)}", f"ragged{int(ragged)}"]
    end = aw[-1] if n and a[-1].isalnum() else ""
    item = len(tail) < 80 and ITEMS.match(tail + " x") is not None and len(WORDS.findall(tail)) < 8
    bare = len(tail) < 4 and BARE.fullmatch(tail) is not None
    out += [f"last {'none' if not end else 'known' if end in known or end.isdigit() else 'new'} item{int(item)} code{int(code_)}", f"bare{int(bare)}", f"item{int(item)} whole{int(whole_end)}"]
    before = next((x.strip()[-1:] for x in reversed(lines[:-1]) if x.strip()), "")
    out += [f"line before {'none' if not before else 'stop' if before in TERMINAL else 'letter' if before.isalpha() else 'other'} item{int(item)} end {kind[:6]}"]
    cut = (not whole_end and not short) or opened > 0 or odd or math or ragged
    out += [f"cut{int(cut)} size{min(size, 5)}", f"hard{int(opened > 0 or odd or math or ragged or bare)}"]
    if code_ and tail not in ("sorry", "```"):
        out.append("code end " + kind)
    told = COUNTED.search(low)
    if told:
        want = NUMBERS.get(told[1]) or (int(told[1]) if told[1].isdigit() else 0)
        have = len(ITEMS.findall(a))
        out.append(f"points {'fewer' if have and have < want else 'none' if not have else 'all'}")
    # who speaks, and of what
    sentences = bucket(sum(map(a.count, ".!?。!?")), (2, 3, 4))
    anywhere, late = near(aw)
    out += [f"says no{int(anywhere)} size{size}", f"says no{int(anywhere)} sentences{sentences}", f"says no{int(late)} late", f"sentences{sentences}"]
    # the question again
    if n:
        if n > 4:
            qb, ab = set(zip(qw, qw[1:])), list(zip(aw, aw[1:]))
            inside = sum(b in qb for b in ab) / len(ab)
            cover = len(qb.intersection(ab)) / max(len(qb), 1)
        else:
            inside, cover = 0.0, 0.0
        sq, sa = set(qw), set(aw)
        bag = len(sa & sq) / len(sa)
        i, c, g = bucket(inside, (0.3, 0.5, 0.65, 0.8, 0.9)), bucket(cover, (0.3, 0.5, 0.65, 0.8, 0.9)), bucket(bag, (0.5, 0.7, 0.85, 0.95))
        long = int(n > 4)
        out += [f"in{i}", f"cover{c}", f"bag{g} long{long}", f"in{i} cover{c}", f"bag{g} cover{c}", f"ratio{bucket(n / max(len(qw), 1), (0.2, 0.5, 0.8, 1.2, 1.8, 2.3))} in{i}"]
    # languages
    ql, _ = tongue(qw, asking)
    al, sure = tongue(aw, low)
    state = "none" if not al or not ql else "same" if al == ql else "asked" if al in asked_for(asking) else "other"
    out += [f"lang {state}", f"lang {state} sure{bucket(sure, (0.5, 0.7, 0.85))}", f"lang {state} size{bucket(n, (4, 8, 15))}"]
    return out, aw


def features(rows: list[tuple[str, str]], known: frozenset[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashed features of all pairs one after the other, their values, how many each has): pair features, and the n-grams of whole answers.

    Each n-gram of up to three words counts once a pair; those of the first three and of the last twelve words count again by
    their place. Single Han characters tell little and don't count. The n-grams of a pair have length one together, so
    that a long answer isn't decided by its many words. The constant is a feature of every pair.
    """
    named: list[int] = []
    counts = np.zeros(len(rows), np.int64)
    words: list[list[str]] = []
    for k, (q, a) in enumerate(rows):
        out, aw = shape(q, a, known)
        named += map(code, out)
        counts[k] = len(out)
        words.append(aw)
    sizes = np.array([len(w) for w in words], np.int64)
    row = [np.repeat(np.arange(len(rows)), counts), np.arange(len(rows))]
    feature = [np.array(named, np.int64) % NAMED, np.full(len(rows), SPACE, np.int64)]
    if sizes.sum():
        seen = pa.array(list(chain.from_iterable(words)), pa.string()).dictionary_encode()
        names = seen.dictionary.to_pylist()
        number = seen.indices.to_numpy()
        h = np.array([zlib.crc32(b"#" if w[0].isdigit() else w.encode()) for w in names], np.int64)[number]
        han = np.array(["一" <= w[0] <= "鿿" for w in names])[number]
        of = np.repeat(np.arange(len(rows)), sizes)
        starts = np.cumsum(sizes) - sizes
        place = np.arange(len(h)) - starts[of]
        left = sizes[of] - place
        two, three = of[:-1] == of[1:], of[:-2] == of[2:]
        b = h[:-1] * 31 + h[1:] * 65599
        grams = [(of[~han], h[~han] * 2654435761 + 17), (of[:-1][two], b[two]), (of[:-2][three], (h[:-2] * 131 + h[1:-1] * 8191 + h[2:] * 127)[three])]
        head, foot = two & (place[:-1] < 3), two & (left[:-1] <= 12)
        grams += [(of[:-1][head], b[head] * 97 + 5), (of[:-1][foot], b[foot] * 613 + 3)]
        key = np.concatenate([o * SPACE + NAMED + (g >> 7) % (SPACE - NAMED) for o, g in grams])
        key.sort()
        key = key[np.append(True, key[1:] != key[:-1])]
        row.append(key // SPACE), feature.append(key % SPACE)
    value = [np.ones(len(f), np.float32) for f in feature[:2]]
    if len(row) > 2:
        value.append((GRAMS / np.sqrt(np.maximum(np.bincount(row[2], minlength=len(rows)), 4)))[row[2]].astype(np.float32))
    row, feature, value = np.concatenate(row), np.concatenate(feature), np.concatenate(value)
    order = np.argsort(row, kind="stable")
    return feature[order], value[order], np.bincount(row, minlength=len(rows))


def scores(weights: np.ndarray, feature: np.ndarray, value: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Log odds of each defect for each pair of hashed features."""
    if not len(sizes):
        return np.zeros((0, len(weights)), np.float32)
    starts = np.cumsum(sizes) - sizes
    return np.stack([np.add.reduceat(w[feature] * value, starts) for w in weights], 1)


def ending(answer: str) -> str | None:
    """The last two sentences of an answer that has more and in which a first person speaks at the end; else None."""
    a = answer.rstrip()
    stops = [m.end() for m in SENTENCE.finditer(a, 0, len(a) - 1)]
    if len(stops) < 2:
        return None
    last = a[stops[-2] :]
    return last if not FIRST.isdisjoint(WORDS.findall(last.lower())) else None


def judge(model: Model, rows: list[tuple[str, str]]) -> np.ndarray:
    """What the scores of each pair exceed the thresholds by. An answer that ends by declining has declined, whatever it began with, so its ending is scored for a refusal too."""
    over = scores(model.weights, *features(rows, model.known)) - model.cuts
    late = [(k, (q, e)) for k, (q, a) in enumerate(rows) if (e := ending(a)) is not None]
    if late:
        d = DEFECTS.index("refusal")
        at = [k for k, _ in late]
        over[at, d] = np.maximum(over[at, d], (scores(model.weights[d : d + 1], *features([p for _, p in late], model.known)) - model.late)[:, 0])
    return over


def pick(rng: np.random.Generator, xs: list):
    return xs[int(rng.integers(len(xs)))]


def refusal(rng: np.random.Generator, lang: str, topic: str = "", families: slice = slice(None)) -> str:
    """A made refusal; ``topic`` may stand for what is asked, ``families`` limits the patterns."""
    lang = lang if lang in PATTERNS else "en"

    def fill(m: re.Match) -> str:
        if topic and m[1] in ("it", "es", "eso", "cela", "zhe") and rng.random() < 0.4:
            return topic
        return pick(rng, SLOTS["limites_fr" if lang == "fr" and m[1] == "limites" else m[1]])

    start, core = pick(rng, OPENINGS[lang]), SLOT.sub(fill, pick(rng, PATTERNS[lang][families]))
    core = " ".join(core.split()) if lang != "zh" else core
    said = start + (core if not start or start.endswith(". ") or core[:2] in ("I ", "I'") else core[0].lower() + core[1:])
    stop = "。" if lang == "zh" else pick(rng, [".", ".", ".", "!"])
    return said[0].upper() + said[1:] + stop + pick(rng, CLOSINGS[lang])


def beginning(rng: np.random.Generator, lang: str) -> str:
    """A few sentences that a long answer may begin with."""
    return " ".join(rng.permutation(BEGINNINGS.get(lang, BEGINNINGS["en"]))[: int(rng.integers(2, 4))]) + " "


def nothing(rng: np.random.Generator) -> str:
    """An answer that says nothing: blank, punctuation, or a word for a missing value, perhaps in brackets."""
    kind = int(rng.integers(3))
    if kind == 0:
        return pick(rng, ["", "", " ", "\n", "\t", "​", "\n\n"])
    if kind == 1:
        return pick(rng, list(".-–—?!_*…")) * int(rng.integers(1, 4)) if rng.random() < 0.6 else pick(rng, ["{}", "[]", "()", '""', "''", "``````", "```\n```", "<p></p>", "<br>"])
    word = pick(rng, list(MISSING))
    a, b = pick(rng, [("", ""), ("", ""), ("(", ")"), ("[", "]"), ("<", ">"), ("", ".")])
    return a + pick(rng, [word, word.upper(), word.capitalize()]) + b


def broken(rng: np.random.Generator, question: str, answer: str, others: dict[str, list[str]], families: slice = slice(None)) -> list[tuple[str, str]]:
    """(defect, answer) made from a pair whose answer looks whole."""
    a, q = answer.strip(), question.strip()
    made = [("empty", nothing(rng))]
    lang = tongue(WORDS.findall(q.lower()), q)[0] or "en"
    asked = q.split()
    topic = " ".join(asked[-int(rng.integers(1, 4)) :]).rstrip("?.!")
    for t in ("", "", topic):
        made.append(("refusal", refusal(rng, lang, t, families)))
    made.append(("refusal", beginning(rng, lang) + refusal(rng, lang, "", families)))
    if len(a) > 40:
        for _ in range(2):
            piece = a[: int(rng.integers(20, len(a) - 2))].rstrip()
            if piece and piece[-1] not in TERMINAL and len(WORDS.findall(piece)) > 3:
                made.append(("truncated", piece))
        if "|" in a and any(map(RULE.match, a.splitlines())):  # within a row of a table
            made.append(("truncated", a[: a.rindex("|", 0, a.rindex("|")) + int(rng.integers(1, 3))].rstrip()))
        items = [m.start() for m in ITEMS.finditer(a)]
        if len(items) > 2 and COUNTED.search(a.lower()):
            made.append(("truncated", a[: items[int(rng.integers(1, len(items)))]].rstrip()))
            made.append(("truncated", beginning(rng, tongue(WORDS.findall(a.lower()), a)[0]) + a[: items[int(rng.integers(1, len(items)))]].rstrip()))
    words = q.split(" ")
    if len(words) > 4:
        k = int(rng.integers(len(words)))
        again = [q, q, q.upper(), q.lower(), q + "\n\n" + q, q + " " + q, " ".join(words[:k] + words[k + 1 :]), " ".join([*words[:k], words[k - 1], *words[k + 1 :]]), q.rstrip("?.!") + ".", '"' + q + '"', q.replace(" ", "  "), pick(rng, ["Question: ", "Q: ", "Frage: ", "Pregunta: ", "> "]) + q]
        made.append(("copy", pick(rng, again)))
    elif len(q) > 8:
        made.append(("copy", pick(rng, [q, q + "\n\n" + q, q + q])))
    strange = [k for k in sorted(others) if k != lang]
    if strange and not asked_for(q.lower()):
        made.append(("wrong_language", pick(rng, others[pick(rng, strange)])))
    return made


def fit(rows: list[tuple[str, str]], seed: int = 0, epochs: int = 4, most: int = 4000, families: slice = slice(None)) -> Model:
    """The classifiers from (question, answer) pairs of which most are sound; at most ``most`` of them are learnt from."""
    rng = np.random.default_rng(seed)
    seen: dict[str, int] = {}
    for q, a in rows:
        for w in {*WORDS.findall(q.lower()), *WORDS.findall(a.lower())[:-1]}:
            seen[w] = seen.get(w, 0) + 1
    known = frozenset(w for w, k in seen.items() if k > 2)
    if len(rows) > most:
        rows = [rows[i] for i in np.sort(rng.permutation(len(rows))[:most])]
    others: dict[str, list[str]] = {}
    tongues = []
    for q, a in rows:
        k = tongue(WORDS.findall(a.lower()), a)[0]
        tongues.append(k or "en")
        if k and len(a) > 40:
            others.setdefault(k, []).append(a)
    others = {k: v for k, v in others.items() if len(v) > 4}
    made = [(q, b, DEFECTS.index(d)) for q, a in rows for d, b in broken(rng, q, a, others, families)]
    # a question with its answer after it is no copy, an apology with an answer no refusal, a long beginning no defect
    sorry = [s for ss in OPENINGS.values() for s in ss if s.rstrip().endswith((".", ","))]
    longer = [i for i, (_, a) in enumerate(rows) if len(a) > 60]
    mixed = [(i, (rows[i][0], x)) for i in longer[::4] for x in (rows[i][0].strip() + "\n\n" + rows[i][1], pick(rng, sorry) + rows[i][1])]
    mixed += [(i, (rows[i][0], beginning(rng, tongues[i]) + rows[i][1])) for i in longer[1::4]]
    n, m = len(rows), len(made)
    feature, value, sizes = features([*rows, *[x[:2] for x in made], *[x for _, x in mixed]], known)
    of = np.array([i for i, _ in mixed], int)
    kind = np.full(n + m + len(mixed), -1)
    kind[n : n + m] = [d for *_, d in made]
    held = rng.random(len(kind)) < 0.2
    starts = np.cumsum(sizes) - sizes
    use = np.ones(len(kind), bool)
    for turn in range(TURNS):
        train = np.flatnonzero(use & ~held)
        if turn:  # what is clearly broken among the pairs of the data shows how it breaks there
            train = np.concatenate([train, np.repeat(np.flatnonzero((own >= 0) & ~held[:n]), 2)])
        target = np.zeros((len(kind), len(DEFECTS)), np.float32)
        target[np.flatnonzero(kind >= 0), kind[kind >= 0]] = 1
        if turn:
            target[np.flatnonzero(own >= 0), own[own >= 0]] = 1
        # the first fit is stopped before it learns the defects among the pairs of the data by heart as sound
        weights = logistic(feature, value, starts, sizes, train, target, rng, epochs if turn == TURNS - 1 else 1)
        score = scores(weights, feature, value, sizes)
        top = score[:n].max(1)
        use[:n] = top < (0 if turn else -1)
        use[n + m :] = use[of]  # what is made from a broken pair isn't sound
        own = np.where(top > 0.5, score[:n].argmax(1), -1)
    # thresholds, on what was held out: sound are pairs of the data that no classifier finds, broken the made ones and those clearly found
    out = np.flatnonzero(held)
    share = np.array([max(float((score[:n].argmax(1)[top >= 0] == d).sum()) / max(n, 1), 0.002) for d in range(len(DEFECTS))])
    cuts = np.array([best_cut(score[out[kind[out] == d], d], score[out[(kind[out] < 0) & use[out]], d], share[d]) for d in range(len(DEFECTS))], np.float32)
    d = DEFECTS.index("refusal")
    ends = [[(q, e) for q, a in of if (e := ending(a)) is not None] for of in ([x[:2] for x in made if x[2] == d], [r for r, u in zip(rows, use) if u])]
    declined, went_on = (scores(weights[d : d + 1], *features(e, known))[:, 0] if e else np.zeros(0) for e in ends)
    return Model(weights, cuts, known, max(float(cuts[d]), best_cut(declined, went_on, LATE)))


def best_cut(broken: np.ndarray, sound: np.ndarray, share: float, precision: float = 0.9) -> float:
    """The threshold of a classifier from held-out scores, where a ``share`` of all pairs is broken; 0 without examples.

    It lies in the middle between the lowest one at which ``precision`` of what is found is broken, and the one that 99 %
    of the broken reach; where these cross, it is the first.
    """
    if not len(broken) or not len(sound):
        return 0.0
    grid = np.linspace(-4, 6, 201)
    hit = share * (broken[None, :] >= grid[:, None]).mean(1)
    false = (1 - share) * (sound[None, :] >= grid[:, None]).mean(1)
    good = hit >= precision * (hit + false)
    # from the lowest threshold above which all are good
    low = float(grid[min(len(grid) - 1, int(np.flatnonzero(~good).max(initial=-1)) + 1)])
    return (low + max(low, float(np.percentile(broken, 1)))) / 2


def logistic(feature: np.ndarray, value: np.ndarray, starts: np.ndarray, sizes: np.ndarray, train: np.ndarray, target: np.ndarray, rng: np.random.Generator, epochs: int, batch: int = 512, rate: float = 0.3, decay: float = 1e-6) -> np.ndarray:
    """Weights of one logistic classifier per column of ``target`` over the rows ``train``, by AdaGrad on mini-batches."""
    weights = np.zeros((target.shape[1], SPACE + 1), np.float32)
    seen = np.full_like(weights, 1e-3)
    order = train.copy()
    for _ in range(epochs):
        rng.shuffle(order)
        for s in range(0, len(order), batch):
            part = order[s : s + batch]
            k = sizes[part]
            ends = np.cumsum(k)
            where = np.repeat(starts[part] - ends + k, k) + np.arange(ends[-1])
            at, x = feature[where], value[where]
            row = np.repeat(np.arange(len(part)), k)
            used, at = np.unique(at, return_inverse=True)
            w = weights[:, used]
            # a small value takes small steps, or the many n-grams of a pair would outweigh its other features
            step = rate * (np.bincount(at, x) / np.bincount(at)).astype(np.float32)
            for d in range(len(w)):
                p = 1 / (1 + np.exp(-np.clip(np.add.reduceat(w[d][at] * x, ends - k), -30, 30)))
                g = np.bincount(at, (p - target[part, d])[row] * x, minlength=len(used)).astype(np.float32) + decay * w[d]
                seen[d, used] += g * g
                w[d] -= step * g / np.sqrt(seen[d, used])
            # n-grams speak for a defect or not at all: else the defects among the pairs of the data would be learnt by heart as sound
            w[:, (used >= NAMED) & (used < SPACE)] = np.maximum(w[:, (used >= NAMED) & (used < SPACE)], 0)
            weights[:, used] = w
    return weights


def sample_pairs(df: DataFrame, id_col: str, text: str, texts: int, seed: int) -> list[tuple[str, str]]:
    """Pairs of the texts of the ``texts`` ids with the smallest hashes: ids are chosen first, so only their texts reach the driver."""
    good = df.where(F.col(id_col).isNotNull() & F.col(text).isNotNull())
    ids = good.select(F.xxhash64(id_col, F.lit(seed)).alias("h")).groupBy("h").agg(F.lit(1)).select("h").orderBy("h").limit(texts).collect()
    if not ids:
        return []
    # few hashes lie below the last one, so the texts are found without a join; repeated rows of an id are one
    rows = good.select(F.xxhash64(id_col, F.lit(seed)).alias("h"), F.col(text).alias("t")).where(F.col("h") <= ids[-1].h).groupBy("h").agg(F.min("t").alias("t")).orderBy("h").limit(texts).collect()
    return [p for r in dict.fromkeys(r.t for r in rows) for p in pairs(r)]


def broken_pairs(df: DataFrame, id_col: str = "id", text: str = "text", sample: int = 2000, seed: int = 0) -> DataFrame:
    """(id, pair_no, defect): the pairs with a defect, of all texts.

    The classifier is fitted on the pairs of at most ``sample`` texts; every pair of every text is then classified by
    its whole text. A pair has the defect with the largest score over its threshold. Null ids and null texts have no
    pairs, texts without user messages neither; repeated rows of an id count once, and if its texts differ, each pair
    found in any of them. Other columns are ignored. Empty input gives no rows.
    """
    spark = df.sparkSession
    schema = "id string, pair_no int, defect string"
    training = sample_pairs(df, id_col, text, sample, seed)
    if not training:
        return spark.createDataFrame([], schema)
    model = spark.sparkContext.broadcast(fit(training, seed))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for big in batches:
            for s in range(0, big.num_rows, 1000):
                b = big.slice(s, 1000)
                ids, numbers, rows = [], [], []
                for i, t in zip(b.column("id").to_pylist(), b.column("text").to_pylist()):
                    for n, p in enumerate(pairs(t), 1):
                        ids.append(i), numbers.append(n), rows.append(p)
                over = judge(m, rows) if rows else np.zeros((0, len(DEFECTS)))
                best = over.argmax(1) if len(over) else np.zeros(0, int)
                hit = np.flatnonzero(over[np.arange(len(over)), best] >= 0)
                yield pa.RecordBatch.from_arrays([pa.array([ids[k] for k in hit], pa.string()), pa.array([numbers[k] for k in hit], pa.int32()), pa.array([DEFECTS[best[k]] for k in hit], pa.string())], names=["id", "pair_no", "defect"])

    rows = df.where(F.col(id_col).isNotNull() & F.col(text).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, schema).distinct()
