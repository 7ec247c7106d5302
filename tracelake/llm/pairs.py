"""P4: question-answer pairs that are empty, cut off, refused, copied or in another language.

Ordered rules look at each pair: emptiness and fillers, copies of the question, refusal phrases of eight
languages with nothing else beside them, script and language against the question's, and an end that
doesn't close its sentence, word or block. Every triggered defect comes out; the first in the rules'
order is the pair's defect.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.langid import SURE_LEAD, LanguageModel, fitted, is_whole, sentences, turns_in, turns_of
from tracelake.llm.truncation import Judge, decided, stem
from tracelake.session import materialise, read, spread

ORDER = ("empty", "copy", "refusal", "other_language", "truncated")
#: Least share of an answer's word pairs that must come from the question, and least share of its length.
COPIED, COPIED_OF_QUESTION = 0.85, 0.6
#: The same share from which slips of a letter are looked for.
ALIKE = 0.5

# What stands for a missing answer.
FILLERS = frozenset(
    ("none", "null", "nil", "nan", "n/a", "na", "#n/a", "undefined", "empty", "blank", "void", "todo", "tbd",
     "no response", "no answer", "no output", "no content", "no reply", "not available", "no data",
     "keine antwort", "sin respuesta", "pas de réponse", "nessuna risposta", "sem resposta", "нет ответа",
     "无", "无回答", "没有回答", "暂无")
)

#: Letters and digits that a filler has at most.
LONGEST_FILLER = max(sum(c.isalnum() for c in f) for f in FILLERS)
_LETTER = re.compile(r"[^\W_]")

# Stems of the names of the eight languages in the eight languages.
LANGUAGE_NAMES = {
    "English": r"\benglish|\benglisch|\bingl[eé]s|\banglais|\binglese|английск|英语|英文",
    "German": r"\bgerman|\bdeutsch|\balem[aáã]n|\balem[aã]o|\ballemand|\btedesc|немецк|德语|德文",
    "Spanish": r"\bspanish|\bspanisch|\bespa[nñ]ol|\bespanhol|\bespagnol|\bspagnol|\bcastellano|испанск|西班牙",
    "French": r"\bfrench|\bfranz[oö]sisch|\bfranc[eéê]s|\bfran[cç]ais|французск|法语|法文",
    "Italian": r"\bitalian|\bitalienisch|\bitalien|итальянск|意大利",
    "Portuguese": r"\bportugu[eéê]s|\bportugiesisch|\bportugais|\bportoghes|португальск|葡萄牙",
    "Russian": r"\brussian|\brussisch|\brus[so]\w*|\brusse|русск|俄语|俄文",
    "Chinese": r"\bchinese|\bchinesisch|\bchin[oê]|\bchinois|\bcines|\bmandarin|китайск|中文|汉语|普通话",
}
_NAMES = {k: re.compile(v, re.I) for k, v in LANGUAGE_NAMES.items()}

# Sentences that decline, and sentences that may stand beside them without giving content.
REFUSALS = (
    r"\bi(?:'m| am)? (?:\w+ )?(?:can't|cannot|can not|could not|couldn't|am unable|unable|am not able|not able|won't|will not|would not|wouldn't|must not|may not) (?:\w+ )?(?:be (?:able|writing|comply|answer)|help|assist|answer|provide|discuss|comply|write|produce|respond|share|give|do that|do this|talk|go into|offer|support|continue|engage|fulfil|complete|generate|create|say)",
    r"\b(?:i )?(?:won't|will not|can't|cannot) be (?:able to|writing|doing|answering|helping)", r"\bunable to (?:assist|help|answer|comply|discuss|provide)", r"\b(?:am|i'm) not (?:able|allowed|permitted|in a position) to",
    r"\bno answer can be given", r"\bnot possible for me\b", r"\boff limits\b", r"\bi(?:'d| would) (?:rather not|prefer (?:not|to stay away|to avoid))", r"\bi (?:must|have to|need to|will have to|'ll have to|am going to|'m going to|respectfully )\s*(?:\w+ )?(?:decline|refuse|pass|turn (?:this|that|it) down)",
    r"\bi'll have to pass\b", r"\bi decline\b", r"\bnot something i (?:can|could|am|will|want|should)", r"\bare not something i can\b", r"\boutside what i am\b", r"\b(?:beyond|outside|falls outside) (?:what i|my|the scope)", r"\bagainst my (?:guidelines|rules|principles|policy|policies)", r"\b(?:don't|do not|wouldn't|would not) feel (?:comfortable|right)",
    r"\b(?:not|wouldn't be|would not be|isn't) appropriate (?:for me )?to", r"\bdon't think i should\b", r"\basked not to\b", r"\blet's (?:talk about|change|move on to|discuss) something else", r"\bas an ai\b.*\b(?:cannot|can't|unable|not able|must)",
    r"\bkann ich (?:\w+ ){0,6}(?:nicht|keine?)\b", r"\bich kann (?:\w+ ){0,6}(?:nicht|keine?)\b", r"\bgebe ich keine\b", r"\bmöchte ich (?:mich )?(?:\w+ ){0,4}nicht\b", r"\blieber nicht\b", r"\bschreibe ich nichts\b", r"\bmuss ich (?:leider )?(?:passen|ablehnen)\b", r"\bich beantworten darf\b", r"\bdarf ich (?:\w+ ){0,5}nicht\b", r"\blehne ich ab\b|\bich lehne\b.*\bab\b",
    r"\bno puedo\b", r"\bno me está permitido\b", r"\bmás allá de lo que puedo\b", r"\bprefiero no\b", r"\bno voy a\b", r"\bno doy información\b", r"\btengo que pasar\b", r"\bdebo (?:rechazar|negarme)\b", r"\btengo que (?:rechazar|negarme)\b",
    r"\bje ne (?:peux|puis|suis|veux|souhaite|saurais)\b", r"\bje dois (?:refuser|décliner)\b", r"\bdépasse ce que\b", r"\bje préfère ne pas\b", r"\bje n'écrirai rien\b", r"\bje passe mon tour\b", r"\bil ne m'est pas permis\b|\bje n'ai pas le droit\b", r"\bje ne donne (?:pas|aucune)\b", r"\bje n(?:e |')\w+ (?:pas|rien|aucune?)\b",
    r"\bnon posso\b", r"\bdevo rifiutare\b", r"\bnon mi è permesso\b", r"\boltre quello che posso\b", r"\bpreferisco non\b", r"\bnon scrivo\b", r"\bnon do informazioni\b", r"\bqui passo\b", r"\bnon sono in grado\b",
    r"\bnão (?:consigo|posso)\b", r"\bnão me é permitido\b", r"\balém do que posso\b", r"\bprefiro não\b", r"\bnão escrevo\b|\bnão vou\b", r"\bnão dou informações\b", r"\btenho de (?:passar|recusar)\b|\bdevo recusar\b",
    r"\bя (?:\w+ )?не могу\b", r"\bвынужден\w* отказать", r"\bмне нельзя\b", r"\b(?:лучше )?не буду\b", r"\bне стану\b", r"\bничего не подскажу\b", r"\bя пас\b", r"\bвыходит за рамки\b", r"\bпредпочитаю не\b|\bпредпочту не\b", r"\bне вправе\b|\bне хочу об этом\b",
    "无法(?:帮助|回答|提供|满足|完成|讨论)", "拒绝这个|必须拒绝|只能拒绝", "不能(?:回答|帮|提供|讨论|谈)", "超出了我", "不提供任何", "不回答了", "不太方便|不方便", "就不说了|不便", "不想(?:谈|说|讨论)",
)
BESIDE = (
    r"^(?:hello|hi|hey|hallo|hola|bonjour|ciao|olá|привет|здравствуйте|你好|sorry|no|nein|non|não|нет|pardon|scusa|regrettably|unfortunately)\b.{0,12}$", r"\bi hope you understand\b", r"\banother topic\b", r"\bsomething else\b", r"\banything else\b", r"\bi understand why you\b", r"\b(?:thank you|thanks) for\b", r"\bspecialist may\b", r"\bask me\b", r"\bi apologi[sz]e\b|\bmy apologies\b|\bi'm sorry\b|^sorry\b",
    r"\betwas anderes\b", r"\b(?:tut mir leid|entschuldig)", r"\botra cosa\b", r"\blo siento\b|\bperdona\b", r"\bautre question\b|\bautre chose\b", r"\bdésolé\b", r"\b(?:pure altro|qualcos'altro)\b", r"\bmi dispiace\b|\bpurtroppo\b", r"\boutra coisa\b|\balguma coisa\b", r"\b(?:lamento|desculpa)\b", r"\bспросите\b|\bо ч[её]м-нибудь\b|\bдругой вопрос\b|\bдругую тему\b|\bчто-нибудь ещё\b|\bдругое\b|\bчем-то ещё\b", r"\b(?:извините|простите|к сожалению)\b", "别的问题|换一个问题|其他问题", "抱歉|对不起|不好意思",
)
# In each language the persons, the denials and the verbs of answering that make a sentence decline when they come together.
DECLINING = (
    (r"\b(?:i|i'm|i'd|i'll|me|my|we|we're)\b", r"\b(?:not|cannot|unable|never|refuse|decline)\b|n't\b", r"\b(?:help|assist|answer|respond|repl(?:y|ies)|discuss|provid|compl[yi]|fulfil|write|writing|produce|generat|engage|share|talk|speak|advis|comment|go into|do (?:this|that)|take (?:this|that) on|request)"),
    (r"\b(?:ich|mir|mich|meine\w*|wir|uns)\b", r"\b(?:nicht|kein\w*|nie|unmöglich|ablehn\w*|verweiger\w*)\b", r"helfen|antwort|äußer|\b(?:schreib|liefer|erstell|bereitstell|besprech|behandel|eingeh|erfüll|nachkomm|unterstütz|weitergeb|auskunft)"),
    (r"\b(?:puedo|podría|podemos|quiero|voy|debo|estoy|mí|mi|mis|me|soy)\b", r"\b(?:no|tampoco|incapaz|imposible|rechaz\w*|negar\w*)\b", r"\b(?:ayud|respond|contest|habl|escrib|ofrec|proporcion|trat|cumpl|asist|atend|compart|coment|complac)"),
    (r"\b(?:je|j|me|mon|ma|nous)\b", r"\bn(?:e\b|')|\b(?:impossible|incapable|refus\w*|déclin\w*)\b", r"\b(?:aid|répond|parl|écri|fourni|discut|trait|satisf|accéd|partag|comment|donner suite)"),
    (r"\b(?:posso|potrei|possiamo|voglio|intendo|sono|mi|me|mio|mia|mie|devo)\b", r"\b(?:non|impossibile|incapace|rifiut\w*|declin\w*)\b", r"\b(?:aiut|rispond|parl|scriv|forn|tratt|soddisf|accontent|condivid|comment|assist)"),
    (r"\b(?:posso|poderia|podemos|consigo|quero|vou|devo|estou|me|mim|meu|minha|minhas|sou)\b", r"\b(?:não|impossível|incapaz|recus\w*|neg\w*)\b", r"\b(?:ajud|respond|fal|escrev|fornec|trat|cumpr|atend|partilh|compartilh|coment|auxili)"),
    (r"\b(?:я|мне|меня|мы|мой|моих)\b", r"\b(?:не|нет|нельзя|невозможно|отказ\w*|отклон\w*)\b", r"\b(?:помо[чг]|ответ|отвеч|обсужд|обсуд|говор|писа|напис|предостав|выполн|делит|комментир|рассказ)"),
    (r"我|本人|我们", r"不|无法|没法|拒绝|未能", r"帮|回答|答复|提供|讨论|谈论|写|满足|协助|分享|评论|解答|处理"),
)
# all of these look at sentences in lower case
_DECLINING = [tuple(map(re.compile, row)) for row in DECLINING]
_REFUSAL = re.compile("|".join(f"(?:{p})" for p in REFUSALS))
# Beginnings of words, one of which stands in whatever REFUSALS and DECLINING match.
_HINT = re.compile(
    r"\b(?:(?:no|not|ne|non|не|нет|nie|off|as an ai)\b|cannot|unable|never|refus|declin|rather|prefer|pass|turn|outside|beyond|falls|against|asked|something|nicht|kein|unmöglich|ablehn|lehn|verweiger|lieber|darf|tampoco|incap|impos|rechaz|neg"
    r"|más|prefier|tengo|debo|dois|dépass|préf|déclin|rifiut|oltre|preferisc|não|além|prefiro|tenho|devo|recus|нельзя|невозм|вынужд|пас\b|выход|предпоч|отказ|отклон)|n't|n'|[不无没拒未超]",
)
_BESIDE = re.compile("|".join(f"(?:{p})" for p in BESIDE))
_SPLIT = re.compile(r"[.!?…]\s+|[。！？]|\n+")
_WORDS = re.compile(r"[㐀-鿿]|[^\W_㐀-鿿]+")
# Words that turn from declining to what is offered instead.
_TURN = re.compile(r"\b(?:but|however|instead|aber|stattdessen|jedoch|pero|sin embargo|mais|cependant|ma|però|tuttavia|mas|porém|но|однако)\b|但|不过")
#: Of a refusal's sentences at most one in so many, but one in any case, neither declines nor accompanies.
OTHER_OF = 6
#: Words after a turn in a declining sentence, or of a short remark, that still give no content.
TURN_WORDS, REMARK_WORDS = 14, 14
#: Words of the longest sentence that may stand beside a refusal.
LONGEST_BESIDE = 20
_FIRST_PERSON = re.compile(r"\b(?:i|i'm|i'd|me|my|ich|mich|mir|yo|me|je|j'ai|moi|io|mi|eu|я|мне)\b|我")


def words(text: str) -> list[str]:
    return _WORDS.findall(unicodedata.normalize("NFKC", text).replace("’", "'").casefold())


def is_empty(answer: str | None) -> bool:
    if answer is None:
        return True
    if sum(1 for _ in islice(_LETTER.finditer(answer), LONGEST_FILLER + 1)) > LONGEST_FILLER:
        return False
    t = "".join(c for c in unicodedata.normalize("NFKC", answer) if unicodedata.category(c) not in ("Cf", "Cc", "Cs", "Co")).strip().casefold()
    if not t or t in FILLERS:
        return True
    inner = t.strip("[](){}<>*_\"'`.…-–—~#|/\\,;:!? ")
    return not inner and not any(unicodedata.category(c) in ("So",) for c in t) or inner in FILLERS


def is_copy(question: str | None, answer: str) -> bool:
    """Nothing but the question, slips of a letter aside: its word pairs make up the answer, and the answer a good part of it or one end."""
    a, q = words(answer), words(question or "")
    if len(a) < 4 or not q:
        return bool(a) and a == q
    have = set(zip(q, q[1:]))
    known = sum(p in have for p in zip(a, a[1:]))
    if ALIKE * (len(a) - 1) <= known < COPIED * (len(a) - 1):
        a = respelt(a, q)
        known = sum(p in have for p in zip(a, a[1:]))
    if known < COPIED * (len(a) - 1):
        return False
    if len(a) >= COPIED_OF_QUESTION * len(q):
        return True
    # the question proper, without what stands around it
    return len(a) >= 6 and (q[-len(a) :] == a or q[: len(a)] == a)


def respelt(words_: list[str], known: list[str]) -> list[str]:
    """``words_`` with each one that isn't among ``known`` put to one of them that is a letter away, if there is one."""
    there = set(known)
    by_shorter = {w[:i] + w[i + 1 :]: w for w in there if len(w) >= 4 for i in range(len(w))}

    def nearest(w: str) -> str:
        if w in there or len(w) < 3:
            return w
        shorter = [w[:i] + w[i + 1 :] for i in range(len(w))]
        return next((v for v in shorter if v in there), None) or by_shorter.get(w) or next((by_shorter[v] for v in shorter if v in by_shorter), w)

    return [nearest(w) for w in words_]


def declines(sentence: str) -> bool:
    """Whether ``sentence``, in lower case, declines: by a set phrase, or by a person, a denial and a verb of answering together."""
    if not _HINT.search(sentence):
        return False
    return bool(_REFUSAL.search(sentence)) or any(n.search(sentence) and p.search(sentence) and v.search(sentence) for p, n, v in _DECLINING)


def size_of(text: str) -> float:
    """Words, with two Han characters for one."""
    n = len(_WORDS.findall(text))
    return n - sum("㐀" <= c <= "鿿" for c in text) / 2


def is_refusal(answer: str) -> bool:
    """Declines, and no sentence beside gives content, however many there are.

    What may stand beside: sentences that excuse, thank or offer another topic, and short remarks in the first
    person. A declining sentence that turns to something else at length gives content.
    """
    n, other, any_declines, pos = 0, 0, False, 0
    ends = ((m.start(), m.end()) for m in _SPLIT.finditer(answer))
    for end, following in chain(ends, ((len(answer), len(answer)),)):
        p = unicodedata.normalize("NFKC", answer[pos:end]).replace("’", "'").strip().lower()
        pos = following
        if not p:
            continue
        n += 1
        if declines(p):
            turn = _TURN.search(p)
            if turn and size_of(p[turn.end() :]) > TURN_WORDS and not _FIRST_PERSON.search(p[turn.end() :]):
                return False
            any_declines = True
            continue
        size = size_of(p)
        if size > LONGEST_BESIDE:
            return False
        if not _BESIDE.search(p):
            # what gives content settles it, so most answers are read no further
            if size > REMARK_WORDS or size > 4 and not _FIRST_PERSON.search(p):
                return False
            other += 1
    return any_declines and other <= max(1, n // OTHER_OF)


def is_asked_in(model: LanguageModel, question: str | None, parts: list[str], scores: np.ndarray, language: str) -> bool:
    """Whether the question names ``language``, has a sentence surely in it, or in good part may be in it; true if it has no text at all."""
    if _NAMES[language].search(question or ""):
        return True
    at = model.names.index(language)
    best = scores.max(1) if len(scores) else np.zeros(0)
    n = np.array([len(s) for s in parts], dtype=float) * (best > 0)
    first, lead, near = model.named(scores)
    if (near & (first == at) & (lead >= SURE_LEAD)).any():
        return True
    # any language that isn't clearly behind may be a question's
    within = (n * (scores[:, at] >= (1 - SURE_LEAD) * best)).sum() if len(scores) else 0.0
    return bool(n.sum() == 0 or within > 0.15 * n.sum())


def is_other_language(model: LanguageModel, question: str | None, asked: tuple[list[str], np.ndarray], said: tuple[list[str], np.ndarray]) -> bool:
    """Wholly in one language, for sure, that the question is neither in nor asks for."""
    parts, scores = said
    first, lead, near = model.named(scores)
    sure = [k for k in np.flatnonzero(near & (lead >= SURE_LEAD)) if is_whole(parts[k])]
    if not sure or len({first[k] for k in sure}) > 1:
        return False
    size = np.bincount(first[near], weights=np.array([len(s) for s in parts], dtype=float)[near], minlength=len(model.names))
    main = int(size.argmax())
    if main != first[sure[0]] or size[main] < 0.8 * size.sum():
        return False
    return not is_asked_in(model, question, *asked, model.names[main])


def other_languages(model: LanguageModel, pairs: list[tuple[str | None, str]]) -> list[bool]:
    """:func:`is_other_language` of each pair; sentences are scored in one go, all of them only where the first ones don't settle it."""
    if not model.names:
        return [False] * len(pairs)
    asked = [sentences(q) or sentences(q, quotes=True) for q, _ in pairs]
    said = [sentences(a) or sentences(a, quotes=True) for _, a in pairs]
    # the first sentences of most pairs are in one language for sure: such an answer isn't wholly in another
    heads = model.scores([x[0] if x else "" for x in (*asked, *said)])
    first, lead, near = model.named(heads)
    sure = near & (lead >= SURE_LEAD)
    n = len(pairs)
    settled = sure[:n] & sure[n:] & (first[:n] == first[n:]) & np.array([bool(x) and is_whole(x[0]) for x in said], dtype=bool)
    out, unsettled = [False] * n, np.flatnonzero(~settled).tolist()
    scores = model.score_lists([x for i in unsettled for x in (asked[i], said[i])])
    for k, i in enumerate(unsettled):
        out[i] = is_other_language(model, pairs[i][0], (asked[i], scores[2 * k]), (said[i], scores[2 * k + 1]))
    return out


def split_pairs(turns) -> list[tuple[int, str | None, str | None]]:
    """``(pair_idx, question, answer)`` of every user turn of ``(role, content)``; the answer is all that stands before the next user turn, None if nothing does."""
    out: list[list] = []
    for role, content in turns:
        role = (role or "").strip().lower()
        if role in ("user", "human", "prompter"):
            out.append([content, None])
        elif role in ("assistant", "gpt", "model", "bot", "chatbot") and out and content is not None:
            out[-1][1] = content if out[-1][1] is None else out[-1][1] + "\n" + content
    return [(i, q, a) for i, (q, a) in enumerate(out)]


PAIR = pa.struct([("pair_idx", pa.int32()), ("defects", pa.list_(pa.string())), ("n_chars", pa.int32()), ("verdict", pa.string()), ("reason", pa.string()), ("keys", pa.list_(pa.string()))])


def pair_defects(conversations: DataFrame, samples: DataFrame) -> DataFrame:
    """``conversation_hash, pair_idx, defects, defect``: every pair with its triggered defects in the rules' order, and the first.

    A pair is a user turn with the answer before the next one; pairs without defect have an empty list and
    a null ``defect``. A null answer is empty, a null or blank question has no language and nothing to
    copy. Copies of a conversation count once (the one with a ``conversation``, then the latest). Null keys
    and conversations without turns give no row, nor do empty tables. Without samples no answer is in
    another language.
    """
    rows = turns_of(conversations)
    shared = conversations.sparkSession.sparkContext.broadcast(fitted(samples))
    kinds = (pa.string(), pa.bool_(), pa.string(), pa.list_(PAIR), pa.string(), pa.int64(), pa.int64())
    names = ["conversation_hash", "full", "at", "found", "key", "uses", "ends"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, judge = shared.value, Judge()

        def table(n: int, **out) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(out[c], k) if isinstance(out.get(c), list) else out.get(c, pa.nulls(n, k)) for c, k in zip(names, kinds)], names=names)

        def totals() -> pa.RecordBatch:
            _, key, uses, ends = judge.handed_on()
            return table(len(key), key=key, uses=uses, ends=ends)

        for b in batches:
            pairs = [split_pairs(t) for t in turns_in(b.column("turns"))]
            answered = [(q, a) for row in pairs for _, q, a in row if not is_empty(a)]
            other = iter(other_languages(model, answered))
            found = []
            for row in pairs:
                out = []
                for i, question, answer in row:
                    if is_empty(answer):
                        out.append({"pair_idx": i, "defects": ["empty"], "n_chars": None, "verdict": None, "reason": None, "keys": None})
                        continue
                    said = stem(answer)
                    rules = (("copy", is_copy(question, said)), ("refusal", is_refusal(said)), ("other_language", next(other)))
                    verdict, reason, keys = judge.verdict(answer, None, None)
                    out.append({"pair_idx": i, "defects": [d for d, hit in rules if hit], "n_chars": len(answer), "verdict": verdict, "reason": reason, "keys": keys})
                found.append(out)
            yield table(len(b), conversation_hash=b.column("conversation_hash"), full=b.column("full"), at=b.column("at"), found=found)
            if judge.full():
                yield totals()
        yield totals()

    fields = "pair_idx:int,defects:array<string>,n_chars:int,verdict:string,reason:string,keys:array<string>"
    source = spread(rows.select("conversation_hash", "full", F.coalesce(F.col("at").cast("string"), F.lit("")).alias("at"), "turns"))
    both = materialise(source.mapInArrow(run, f"conversation_hash string, full boolean, at string, found array<struct<{fields}>>, key string, uses bigint, ends bigint"))
    best = both.where("key is null").groupBy("conversation_hash").agg(F.max_by("found", F.struct("full", "at", F.size("found"))).alias("found"))
    ruled = materialise(best.select("conversation_hash", F.explode("found").alias("f")).select("conversation_hash", "f.*", F.lit(None).cast("string").alias("source")))
    texts = ruled.where("verdict is not null and verdict != 'blank'").select("conversation_hash", "pair_idx", "source", "n_chars", "verdict", "reason", "keys")
    counted = both.where("key is not null").select(F.lit(None).cast("string").alias("source"), "key", "uses", "ends")
    cut = decided(texts, counted, ["conversation_hash", "pair_idx"]).where("verdict = 'cut'").select("conversation_hash", "pair_idx", F.lit(True).alias("cut"))
    joined = ruled.select("conversation_hash", "pair_idx", "defects").join(cut, ["conversation_hash", "pair_idx"], "left")
    defects = F.when(F.coalesce("cut", F.lit(False)), F.concat("defects", F.array(F.lit("truncated")))).otherwise(F.col("defects"))
    return joined.select("conversation_hash", "pair_idx", defects.alias("defects")).withColumn("defect", F.try_element_at("defects", F.lit(1)))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_defects(read(spark, sf_dir, "wildchat"), read(spark, sf_dir, "lang_samples")).where("defect is not null").select("conversation_hash", "pair_idx", "defect")


def p4_all_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per pair and triggered defect."""
    return pair_defects(read(spark, sf_dir, "wildchat"), read(spark, sf_dir, "lang_samples")).select("conversation_hash", "pair_idx", F.explode("defects").alias("defect"))
