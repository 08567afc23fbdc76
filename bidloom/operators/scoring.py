"""Default, external and stub scores, and the pluggable model scorer with its refine rounds."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import METHOD_DEFAULT, METHOD_EXPIRED, ScoreConfig
from ..functions.numbers import clamp, col, round_half
from ..functions.text import as_texts, first_code, json_texts, strip
from .codes import fit_for_codes

# The fields of a description after the subject, in order, and the text for none.
DETAIL_FIELDS = ("customer", "okpd2_code", "okpd2_name", "nmck", "law", "region")
NO_DESCRIPTION = "(описание отсутствует)"


def default_scores(cards: DataFrame, now: Column, config: ScoreConfig, code: Column | None = None) -> DataFrame:
    """Adds fit, score and score_method; cards past their deadline score 0. A score that a card has stays, with its method."""
    rows = fit_for_codes(cards, first_code("okpd2_codes") if code is None else code, config.fit_table, config.default_fit)
    score = round_half(F.col("fit") * F.lit(float(config.p_win)) * F.coalesce(F.col("nmck"), F.lit(0.0)))
    expired = F.coalesce(F.col("deadline") < now, F.lit(False))
    score, method = F.when(expired, 0.0).otherwise(score), F.when(expired, METHOD_EXPIRED).otherwise(METHOD_DEFAULT)
    if "score" in cards.columns:
        own = F.col("score").isNotNull()
        method = F.when(own, F.col("score_method") if "score_method" in cards.columns else F.lit(None)).otherwise(method)
        score = F.when(own, F.col("score")).otherwise(score)
    return rows.withColumns({"score": score, "score_method": method})


def margin(nmck: Column | str, rate: float) -> Column:
    return round_half(F.coalesce(col(nmck), F.lit(0.0)) * F.lit(float(rate)))


def external_score(final_fit: Column | str, nmck: Column | str, config: ScoreConfig) -> Column:
    fit = clamp_fit(final_fit)
    if config.normalize_fit:
        fit = fit / F.lit(float(config.max_fit))
    return round_half(fit * F.lit(float(config.p_win)) * margin(nmck, config.margin_rate), config.digits)


def clamp_fit(c: Column | str) -> Column:
    return round_half(clamp(c, 0, 10))


def stub_scores(cards: DataFrame, config: ScoreConfig, score: str = "score") -> DataFrame:
    """Adds score, final_fit_score, p_win and margin: the score that the card has already."""
    own = round_half(F.coalesce(F.col(score), F.lit(0.0)), config.digits)
    return cards.withColumns({"score": own, "final_fit_score": clamp_fit(own), "p_win": F.lit(float(config.p_win)), "margin": margin("nmck", config.margin_rate)})


def description(detail_json: Column | str | None, *flat: str, subject: str = "subject") -> Column:
    """The subject, the JSON's fields, then flat fields that no line names yet, each on a line of its own."""
    words = lambda c: F.array_join(F.filter(F.split(strip(c), r"(?U)\s+"), lambda w: w != ""), " ")

    def lines(values: Column, names: list[str]) -> Column:
        """``name: words`` of each value, null where there are none."""
        named = F.transform(values, lambda v, i: F.struct(F.element_at(F.array(*map(F.lit, names)), i + 1).alias("name"), words(v).alias("words")))
        return F.transform(named, lambda x: F.when(x["words"] != "", F.concat(x["name"], x["words"])))

    found = lines(as_texts(subject), [""])
    if detail_json is not None:
        own = lines(json_texts(detail_json, *DETAIL_FIELDS), [f"{f}: " for f in DETAIL_FIELDS])
        found = F.concat(found, F.coalesce(own, F.array().cast("array<string>")))
    found = F.array_compact(found)
    given = [f for f in DETAIL_FIELDS if f in flat]
    more = lines(as_texts(*given), [f"{f}: " for f in given]) if given else None
    if more is not None:

        def add(lines: Column, line: Column) -> Column:
            mark = F.substring_index(line, " ", 1)
            named = F.exists(lines, lambda x: F.contains(x, mark))
            return F.when(named, lines).otherwise(F.concat(lines, F.array(line)))

        found = F.aggregate(F.array_compact(more), found, add)
    return F.element_at(F.transform(F.array(found), lambda x: F.when(F.size(x) > 0, F.array_join(x, "\n")).otherwise(NO_DESCRIPTION)), 1)


RESULT = "procurement_id long, fit_score double, verdict string, critics string, final_fit_score double, rounds int"
Fit = Callable[[list[str], list[str]], list[float]]
Judge = Callable[[list[str], list[float]], list[tuple[str, str, float]]]


def model_scores(cards: DataFrame, fit: Fit, judge: Judge, refine_rounds: int = 1) -> DataFrame:
    """Scores by an injected model: fit(descriptions, hints), then judge(descriptions, fits) -> verdict, critics, final.

    The model gets batches of texts. Those with the verdict reject are fitted again with their critics as hints, at most
    ``refine_rounds`` times; the last judgement counts. ``cards`` has procurement_id and description.
    """

    def run(frames):
        import pandas as pd

        clamp = lambda x: min(max(x, 0.0), 10.0)
        for frame in frames:
            texts = frame["description"].tolist()
            fits = list(fit(texts, [""] * len(texts))) if texts else []
            said = list(judge(texts, fits)) if texts else []
            rounds = [0] * len(texts)
            for _ in range(refine_rounds):
                again = [k for k, (verdict, _, _) in enumerate(said) if verdict == "reject"]
                if not again:
                    break
                own = [texts[k] for k in again]
                new = fit(own, [said[k][1] for k in again])
                for k, value, judged in zip(again, new, judge(own, new), strict=True):
                    fits[k], said[k], rounds[k] = value, judged, rounds[k] + 1
            rows = [(key, clamp(f), verdict, critics, clamp(final), n) for key, f, (verdict, critics, final), n in zip(frame["procurement_id"], fits, said, rounds, strict=True)]
            yield pd.DataFrame(rows, columns=["procurement_id", "fit_score", "verdict", "critics", "final_fit_score", "rounds"])

    return cards.select("procurement_id", "description").mapInPandas(run, RESULT)


def prompt(template: str, **values: Column) -> Column:
    """A prompt for a model: a template whose {names} are replaced by columns; nulls become empty."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


# The headings of a model's inputs.
COMPETENCIES, DESCRIPTION, ESTIMATE = "КОМПЕТЕНЦИИ ПОСТАВЩИКА:\n", "ОПИСАНИЕ ЗАКУПКИ:\n", "ОЦЕНКА МОДЕЛИ (JSON):\n"


@dataclass(frozen=True)
class Example:
    """A card's description with the answer that a model should give; negative ones share words, not meaning."""

    description: str
    fit_score: float
    reasoning: dict[str, str]
    negative: bool = False


def _message(role: str, *parts: Column | str) -> Column:
    content = F.concat(*[F.coalesce(p, F.lit("")) if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def fit_messages(system: str, examples: list[Example], competencies: Column, description: Column) -> Column:
    """array<struct<role, content>>: the system's text, question and answer of each example, then the card's question."""
    out = [_message("system", system)]
    for e in examples:
        answer = {"reasoning": e.reasoning, "fit_score": e.fit_score}
        out.append(_message("human", f"[{'NEGATIVE' if e.negative else 'POSITIVE'}] {DESCRIPTION}{e.description}"))
        out.append(_message("ai", json.dumps(answer, ensure_ascii=False)))
    return F.array(*out, _message("human", COMPETENCIES, competencies, "\n\n" + DESCRIPTION, description))


def judge_messages(system: str, competencies: Column, description: Column, answer: Column, task: str = "") -> Column:
    """The same for a judge, who sees the answer but no examples."""
    return F.array(_message("system", system), _message("human", COMPETENCIES, competencies, "\n\n" + DESCRIPTION, description, "\n\n" + ESTIMATE, answer, f"\n\n{task}" if task else ""))
