"""Query compilation (on the driver) and text expressions (native)."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

#: Words that carry no content (fixed values).
STOP_WORDS = frozenset("""
что чего чем чём кто кого кому где когда почему зачем как какой какая какие какое который которая
которые которую которого было была были будет есть был быть делала делал делали случилось произошло
происходило говорили говорила говорил сказала сказал писала писал обсуждали обсуждала обсуждал
спрашивал спрашивала рассказывал рассказывала упоминал упоминала помню помнишь вспомни вспомнить
напомни знаешь знаю сделала сделал вчера сегодня про по во в на с со и а у за о об к от до из же ли это
этот эта эти того этого мы вы он она они мне меня нас них там тут вот уже ещё еще или для при без над
под ну бы ведь тоже также очень можно нужно надо мой моя мои моё твой его её их наш ваш себя сам сама
сами все всё так да нет только мной мною нами тобой тобою вами
what happened did do does done i we you the a an on at in about of to for was were is are there my me
which who whom how when where why and or but with from by this that these those it its be been have
has had not no yes so if then than just also can could would should will our your their them they he
she his her us any some all tell told remember recall know knew said say talk talked discuss discussed
""".split())
#: Spellings of names in Latin letters (fixed values).
LATIN = {
    "хабр": "habr", "хабра": "habr", "хабре": "habr", "хабром": "habr", "гитхаб": "github", "гитхаба": "github", "гитхабе": "github",
    "ютуб": "youtube", "ютуба": "youtube", "ютубе": "youtube", "телеграм": "telegram", "телеграма": "telegram", "телеграме": "telegram",
    "телега": "telegram", "телеге": "telegram", "архив": "arxiv", "архиве": "arxiv", "арксив": "arxiv", "реддит": "reddit",
    "реддите": "reddit", "твиттер": "twitter", "твиттере": "twitter",
}
MAX_QUERY_CHARS, MAX_TERMS, MIN_TERM = 1024, 16, 3
#: A word character as other engines see it: letters, digits and the underscore.
W = r"[\p{L}\p{N}_]"
_WORD = r"[\w@#-]+(?:\.[\w-]+)*(?:\+[\w-]+(?:\.[\w-]+)*)?"


def is_russian(term: str) -> bool:
    return re.fullmatch("[а-яё]+", term, re.IGNORECASE) is not None


def stem(term: str) -> str:
    """Russian words lose one letter from five, two from seven letters on; others stay whole."""
    cut = 0 if not is_russian(term) or len(term) < 5 else 1 if len(term) < 7 else 2
    return term[: len(term) - cut]


def terms(query: str) -> list[str]:
    """Content words of a query in order of first occurrence, each followed by its Latin spelling."""
    words = (w.lstrip("@#") for w in re.findall(_WORD, query.lower()))
    spelled = (x for w in words if len(w) >= MIN_TERM and w not in STOP_WORDS for x in (w, LATIN.get(w)) if x)
    return list(dict.fromkeys(spelled))


def pattern(term: str, w: str = W) -> str:
    """Java pattern for a whole term. Dotted terms don't match inside longer versions; Russian stems take endings."""
    body = re.sub(r"([^\w\s])", r"\\\1", term)
    if "." in term:
        return rf"(?<!{w})(?<!{w}[.+-]){body}(?!{w})(?![.+-]{w})"
    ending = "[а-яё]*" if is_russian(term) and len(term) >= 4 else ""
    return rf"(?<!{w}){body}{ending}(?!{w})"


def conditions(query: str) -> dict[str, list[str]]:
    """Stem to the terms that satisfy it; at most MAX_TERMS conditions."""
    groups: dict[str, list[str]] = {}
    for t in terms(query[:MAX_QUERY_CHARS]):
        own = groups.setdefault(stem(LATIN.get(t, t)), [])
        if stem(t) not in own:
            own.append(stem(t))
    return dict(list(groups.items())[:MAX_TERMS])


def required(n: int) -> int:
    """How many of n conditions a record must meet."""
    return n if n <= 2 else max(2, -(-n // 2))


def overlap(text: Column, query: str) -> Column:
    """How many of the query's conditions a text meets, in one projection."""
    out = F.lit(0)
    for options in conditions(query).values():
        out = out + text.rlike("(?iu)" + "|".join(map(pattern, options))).cast("int")
    return out


def match_score(text: Column, stems: list[str]) -> Column:
    """How many of the stems a text has as whole terms."""
    out = F.lit(0)
    for x in stems:
        out = out + text.rlike("(?iu)" + pattern(x)).cast("int")
    return out


@F.pandas_udf(T.StringType())
def _casefold(values: pd.Series) -> pd.Series:
    return values.map(lambda x: None if x is None else x.casefold())


def casefold(text: Column) -> Column:
    """Caseless form of a text; Python is asked only where there is more than ASCII."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), _casefold(text)).otherwise(F.lower(text))


#: Days after which confidence falls to 1/e, by kind (fixed values).
PERIODS = {"event": 7, "decision": 90, "preference": 90, "belief": 365, "fact": 365}


def rank(overlap: Column, confidence: Column, created_at: Column, kind: Column, now: float) -> Column:
    """Overlap, plus exponentially fading confidence, plus hyperbolically fading recency."""
    period = F.lit(365.0)
    for name, days in PERIODS.items():
        period = F.when(kind == name, float(days)).otherwise(period)
    age = F.greatest(F.lit(0.0), F.lit(float(now)) - created_at) / 86400.0
    return overlap + 0.6 * confidence * F.exp(-age / period) + 0.4 * period / (period + age)


_B, _E = rf"(?<!{W})", rf"(?!{W})"
#: Patterns of kinds, the first that matches wins (fixed values, with explicit word bounds).
KINDS = [
    ("decision", rf"{_B}(decid{W}*|reshi{W}*|реши{W}*|chose|chosen|will|going to|plan to|agreed){_E}"),
    ("preference", rf"{_B}(prefer{W}*|предпоч{W}*|like|dislike|always|never|don't|avoid){_E}"),
    ("belief", rf"{_B}(believ{W}*|думаю|i think|suspect|expect|assume){_E}"),
    ("event", rf"{_B}(\p{{Nd}}{{4}}-\p{{Nd}}{{2}}-\p{{Nd}}{{2}}|met|happened|shipped|deployed|called){_E}"),
]


def classify_kind(text: Column) -> Column:
    out = F.lit("fact")
    for name, rule in reversed(KINDS):
        out = F.when(text.rlike("(?iu)" + rule), name).otherwise(out)
    return out


_S = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"
_NS = r"[^\s\x0B\x1C-\x1F\x85\p{Z},;]"
#: Patterns of secrets, applied in order (fixed values, with explicit word bounds).
SECRETS = [
    r"sk-[A-Za-z0-9_-]{12,}",
    rf"{_B}AKIA[0-9A-Z]{{16}}{_E}",
    rf"{_B}eyJ[A-Za-z0-9_-]{{8,}}\.[A-Za-z0-9_-]{{8,}}\.[A-Za-z0-9_-]{{8,}}(?:(?<=-)(?={W})|(?<={W}){_E})",
    rf"{_B}\p{{Nd}}{{6,}}:[A-Za-z0-9_-]{{25,}}(?:(?<=-)(?={W})|(?<={W}){_E})",
    rf"(?iu){_B}bearer{_S}+[A-Za-z0-9._-]{{12,}}",
    rf"(?iu)(token|api[_-]?key|access[_-]?key|private[_-]?key|bot[_-]?token|password|passphrase|secret|mnemonic|seed[_ ]?phrase|authorization){_S}*[:=]{_S}*{_NS}+",
]


def redact_secrets(text: Column) -> Column:
    for rule in SECRETS:
        text = F.regexp_replace(text, rule, "[REDACTED_SECRET]")
    return text


def token_set(text: Column) -> Column:
    """Distinct lower-case words of three letters or more."""
    found = F.regexp_extract_all(F.lower(text), F.lit(rf"{W}+"), F.lit(0))
    return F.filter(F.array_distinct(found), lambda t: F.length(t) > 2)
