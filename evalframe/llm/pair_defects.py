"""Problem 5: broken prompt and response pairs, by ordered rules that each look at one kind of defect."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from evalframe.llm.answers import Answer, letters_digits, parse_answer
from evalframe.session import spread

#: Placeholders that stand for no content.
PLACEHOLDERS = {"", "na", "null", "none", "nil", "nan", "todo", "tbd", "tba", "empty", "undefined", "placeholder", "unknown", "noanswer", "待补充", "无", "暂无", "略"}

#: Refusals: somebody declines to write, solve, answer or help. One pattern per language, fixed values.
REFUSALS = [
    r"\bi(?:'|’)?m sorry\b|\bi am sorry\b|\bi (?:can(?:'|’)?t|cannot|can not|won(?:'|’)?t|will not|am unable to|am not able to|must decline|have to decline|do not|don(?:'|’)?t) (?:help|assist|write|solve|answer|provide|produce|comply|code|do|give|offer)\b|\bmust decline\b|\bas an? (?:ai|assistant|language model)\b.*\b(?:not able|unable|cannot|can(?:'|’)?t)\b|\bi am not able to\b|\boutside what i do\b|\bi (?:must |have to |will )?(?:refuse|decline) to\b",
    r"抱歉|对不起|很遗憾|(?:无法|不能|没办法|不会|拒绝|不便|不予)(?:解答|回答|提供|给出|编写|帮助|协助|完成这|处理这)|作为(?:一个)?(?:语言模型|人工智能|AI|助手)|超出了?我的能力|我不(?:编写|提供|能|会|回答)",
    r"\blo siento\b|\bdisculpa\b|\blamento\b|\bno puedo (?:resolver|ayudar|escribir|responder|dar|ofrecer)\b|\bcomo (?:asistente|modelo)\b",
    r"\bes tut mir leid\b|\bentschuldigung\b|\bleider (?:kann|darf|muss)\b|\bich kann (?:dir |ihnen |das |diese |die |dabei |hier )*(?:nicht|leider|keine)\b|\bals (?:ki|assistent|sprachmodell)\b",
    r"\bje suis désolé|\bdésolée?\b|\bje ne peux pas\b|\bmalheureusement\b",
    r"извин|к сожалению|прошу прощения|не могу (?:решить|помочь|написать|ответить|дать)|как (?:языковая модель|ассистент|помощник)|я не (?:пишу|решаю|могу)",
    r"申し訳|すみません|ごめん|(?:お手伝い|回答|解答|お答え|解くこと|作成|提供).{0,6}(?:できません|できない|いたしかね|しません)|残念ながら",
    r"죄송|미안|유감|(?:도와|풀어|작성해|답변|제공).{0,8}(?:수 없|못|않)",
    r"क्षमा|माफ|खेद|(?:हल|मदद|सहायता).{0,12}नहीं कर सकत",
    r"آسف|أعتذر|عذر[اًا]|للأسف|لا (?:أستطيع|يمكنني)",
    r"\bmi dispiace\b|\bnon posso (?:aiutare|risolvere|scrivere|rispondere|fornire)\b|\bcome (?:assistente|modello linguistico)\b",
    r"\b(?:sinto muito|desculpe|lamento)\b|\bnão posso (?:ajudar|resolver|escrever|responder|fornecer)\b|\bcomo (?:assistente|modelo de linguagem)\b",
    r"\bprzykro mi\b|\bprzepraszam\b|\bnie mogę (?:pomóc|rozwiązać|napisać|odpowiedzieć)\b|\bjako (?:asystent|model językowy)\b",
    r"\büzgünüm\b|\bmaalesef\b|\b(?:yardımcı olamam|çözemem|yazamam|cevaplayamam)\b",
    r"ขออภัย|ขอโทษ|เสียใจ|ไม่สามารถ(?:ช่วย|ตอบ|แก้|เขียน|ให้)",
]
_REFUSAL = re.compile("|".join(f"(?:{x})" for x in REFUSALS), re.I | re.S)
_UNIT = re.compile(r"[一-鿿]|[^\W_一-鿿]+")
_HAN_RUN = re.compile(r"[一-鿿]+")
_HAN = re.compile(r"[㐀-䶿一-鿿]")
_KANA_HANGUL = re.compile(r"[぀-ヿㇰ-ㇿ가-힯ᄀ-ᇿ]")
_LETTER = re.compile(r"[^\W\d_]")
_RAW = re.compile(r'R"([^\s()\\]{0,16})\(.*?\)\1"', re.S)
_CPP_NOISE = re.compile(r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|//[^\n]*|/\*.*?\*/', re.S)
_VALUE = re.compile(r"^[\s*_`$]*(?:unknown|n/?a|o\s*\(.*\))[\s*_`$.。]*$", re.I | re.S)
_HEADING = re.compile(r"^[ \t>#*\-•]*(?:solution\s+explanation|time\s+complexity|space\s+complexity)\b[ \t*_]*[:：\-–—=]?", re.I | re.M)
_ENDS = tuple("。！？.!?…）)”\"」』》]】`;；:*")


def _is_placeholder(text: str | None) -> bool:
    return text is None or letters_digits(text) in PLACEHOLDERS


def nothing_but_headings(a: Answer) -> bool:
    """No field and no loose text holds anything besides placeholders."""
    return all(_is_placeholder(x) for x in (a.explanation, a.time, a.space, a.code, a.loose))


def _units(text: str) -> list[str]:
    """Single Chinese characters, and longest runs of other letters and digits."""
    return _UNIT.findall(text.lower())


def copies_prompt(a: Answer, text: str, prompt: str | None, share: float = 0.5, least: int = 6) -> bool:
    """At least ``share`` of the 3-unit runs of the body (explanation and loose text) stand in the prompt."""
    if not prompt:
        return False
    body = "\n".join(x for x in (a.explanation, a.loose) if x)
    if not body:
        return False
    units = _units(body)
    need = share * (len(units) - 2)
    if len(units) - 2 < least:
        return False
    if not _HAN.search(prompt) and len(units) - sum(map(len, _HAN_RUN.findall(body))) < need:
        return False  # too few units that could stand in a prompt without Chinese
    there = _units(prompt)
    known = set(zip(there, there[1:], there[2:]))
    return sum(g in known for g in zip(units, units[1:], units[2:])) >= need


def program_complete(code: str | None) -> bool:
    """The program is there and is not cut off: outside strings and comments its brackets close and it ends a block or statement."""
    if not code or not letters_digits(code):
        return False
    bare = _CPP_NOISE.sub(" ", _RAW.sub(" ", code) if 'R"' in code else code).rstrip()
    if not bare or bare[-1] not in "};":
        return False
    depth = bare.count("{") - bare.count("}")
    return depth <= 0 and bare.count("(") <= bare.count(")")


def truncated(a: Answer) -> bool:
    """Breaks off before explanation, both complexities and program are complete; an open fence alone does not count."""
    if not a.explanation or not letters_digits(a.explanation):
        return True
    if a.last == "explanation" and not a.explanation.rstrip().endswith(_ENDS):
        return True
    if not all(v is not None and _VALUE.match(v) for v in (a.time, a.space)):
        return True
    return not program_complete(a.code)


def other_language(a: Answer, han_share: float = 0.3) -> bool:
    """The explanation's letters are mostly not Chinese, or it holds kana or hangul as prose."""
    body = a.explanation or ""
    letters = len(_LETTER.findall(body))
    if not letters:
        return False
    han, foreign = len(_HAN.findall(body)), len(_KANA_HANGUL.findall(body))
    return han < han_share * letters or foreign > 0.15 * letters


def answer_defects(text: str | None, prompt: str | None) -> list[str]:
    """Every triggered defect of an answer, in the order of the rules; the rules are asked independently.

    By their definitions some exclude each other: an empty answer has no content that another rule could look
    at, ``other_language`` is said of complete answers only, and a refusal declines instead of solving, so an
    apology beside a program is none.
    """
    if text is None or not text.strip():
        return ["empty"]
    a = parse_answer(text)
    if nothing_but_headings(a):
        return ["empty"]
    found = []
    if copies_prompt(a, text, prompt):
        found.append("copies_prompt")
    if (not a.code or not letters_digits(a.code)) and _REFUSAL.search((a.explanation or "") + "\n" + a.loose):
        found.append("refusal")
    if truncated(a):
        found.append("truncated")
    elif other_language(a):
        found.append("other_language")
    return found


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for i, prompt, chosen, rejected in zip(*(c.to_pylist() for c in batch.columns)):
            if prompt is None or not prompt.strip():
                out.append((i, "prompt", "empty", 1))
            for name, text in (("chosen", chosen), ("rejected", rejected)):
                out.extend((i, name, d, k) for k, d in enumerate(answer_defects(text, prompt), 1))
        cols = list(zip(*out)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int32())], names=["pair_id", "field", "defect", "rule_order"])


def pair_defects(df: DataFrame, id_col: str = "pair_id", prompt_col: str = "prompt", chosen_col: str = "chosen", rejected_col: str = "rejected") -> DataFrame:
    """pair_id, field, defect, rule_order: every defect that a field triggers; rule_order 1 is the first that applies.

    The rules are independent of each other: ``rule_order`` only ranks what they found. A null or blank prompt is ``empty`` and has no other defect; a null answer is ``empty``. Empty
    tables give no rows, repeated rows one result each.
    """
    cols = [F.col(id_col).cast("long").alias("pair_id"), *[F.col(c).cast("string") for c in (prompt_col, chosen_col, rejected_col)]]
    return spread(df.select(*cols)).mapInArrow(_rows, "pair_id long, field string, defect string, rule_order int")
