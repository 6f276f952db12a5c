"""The language that a text shows: by its script, else by its function words.

A function word that several languages share counts for each in equal parts. Texts in a language that isn't listed, or
without any function word, show none: they aren't taken for another language.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable

# Articles, pronouns, prepositions, conjunctions and auxiliaries of languages in Latin script.
FUNCTION_WORDS = {
    "de": "der die das den dem des ein eine einen einem einer und oder aber nicht ist sind war wird werden wurde hat haben ich du er sie es wir ihr mit von vom zu zum zur für auf aus bei nach über unter vor im in an am als auch nur noch schon wenn dass daß weil wie was wer wo kein keine sich so doch durch um man mehr sein kann dann hier da",
    "en": "the a an of and or but not is are was were be been to in on at by for with from as that this these those it its he she they we you i his her their our your has have had will would can could should do does did what which who how when where why if then than there so no only also more about into between after before both each while since",
    "es": "el la los las un una unos unas de del y o u pero no es son era fue ser está están a al en con por para sin sobre entre como más que se lo le les su sus mi tu si sí ya muy también cuando donde qué cómo quién porque este esta estos estas ese esa eso hay ha han tras desde hasta cada otro ni según pues",
    "fr": "le la les l un une des du de d et ou mais ne pas est sont était être a ont à au aux en dans avec pour par sur sans sous entre comme plus que qu qui quoi ce cet cette ces se s il elle on nous vous ils elles je son sa ses leur leurs si très aussi quand où comment pourquoi puis donc car chaque après avant selon même y",
    "it": "il lo la gli le un uno una di del della dei delle degli e o ma non è sono era essere a al alla ai in nel nella con per da dal dalla su sul sulla tra fra come più che chi cosa si suo sua questo questa quello se anche quando dove perché ha hanno molto ogni dopo prima anche ne ci",
    "pt": "o a os as um uma uns umas de do da dos das e ou mas não é são era foi ser está em no na nos nas com por para pelo pela sem sobre entre como mais que quem se seu sua este esta isso isto também quando onde porque há tem muito cada depois antes até já ao à",
    "nl": "de het een en of maar niet is zijn was waren wordt worden van voor met op in aan bij naar uit over onder als ook nog dan dat die deze dit wat wie hoe waar er ik je jij hij zij we wij hun haar geen meer kan door om te tot tussen na",
    "sv": "den det de en ett och eller men inte är var som på av för med till från om under över mellan när hur vad vem han hon vi ni jag sig sin har hade kan ska också bara mer efter innan alla varje",
    "pl": "i w we z ze na do od po za przez dla o nie jest są był była być się to ten ta te że jak co kto gdzie kiedy ale lub oraz też tylko już jego jej ich może przed między",
    "tr": "ve bir bu şu o ile için de da ki ne mi mı değil ama veya gibi daha çok her kadar sonra önce olan olarak var yok ben sen biz siz onlar",
}
# Scripts that tell a language, or that several write in.
SCRIPTS = (
    ("ja", re.compile(r"[぀-ヿ]"), 0.5),
    ("zh", re.compile(r"[㐀-鿿]"), 0.4),
    ("ko", re.compile(r"[가-힯]"), 0.5),
    ("cyrillic", re.compile(r"[Ѐ-ӿ]+"), 1.0),
    ("el", re.compile(r"[Ͱ-Ͽἀ-῿]{2,}"), 1.0),
    ("ar", re.compile(r"[؀-ۿ]+"), 1.0),
    ("he", re.compile(r"[֐-׿]+"), 1.0),
    ("hi", re.compile(r"[ऀ-ॿ]+"), 1.0),
    ("th", re.compile(r"[฀-๿]+"), 2.0),
)
UNKNOWN = "unknown"
WORDS = re.compile(r"[^\W\d_]+")
_SHARED = Counter(w for ws in FUNCTION_WORDS.values() for w in set(ws.split()))
_OF: dict[str, tuple[tuple[str, float], ...]] = {
    w: tuple((k, 1.0 / n) for k, ws in FUNCTION_WORDS.items() if w in set(ws.split())) for w, n in _SHARED.items()
}


def marks(words: Iterable[str], text: str) -> tuple[dict[str, float], dict[str, float]]:
    """What speaks for each language in lower-case ``words`` and in the scripts of ``text``: in shares, and in full."""
    hits: dict[str, float] = {}
    full: dict[str, float] = {}
    total = 0.0
    for w, n in Counter(filter(_OF.__contains__, words)).items():
        total += n
        for k, v in _OF[w]:
            hits[k] = hits.get(k, 0.0) + v * n
            full[k] = full.get(k, 0.0) + n
    if not text.isascii():
        for k, pattern, weight in SCRIPTS:
            n = len(pattern.findall(text)) * weight
            if n:
                hits[k] = full[k] = n
                total += n
        if "ja" in hits and "zh" in hits:  # Japanese writes in both
            loser, winner = ("zh", "ja") if hits["ja"] * 4 >= hits["zh"] else ("ja", "zh")
            hits[winner] = full[winner] = hits[winner] + hits.pop(loser)
            del full[loser]
    full[""] = total
    return hits, full


def tongue(words: Iterable[str], text: str) -> tuple[str, float]:
    """(language, the share of all that tells languages which is its own); '' and 0 where nothing tells. Ties go to the first by name."""
    hits, full = marks(words, text)
    if not hits:
        return "", 0.0
    best = min(hits, key=lambda k: (-hits[k], k))
    return best, full[best] / full[""]
