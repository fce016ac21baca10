"""Declared input schemas, one per corpus, and the schemas the jobs write."""

from __future__ import annotations

SCHEMAS: dict[str, str] = {
    "cnn_daily_mail": "row_id bigint, article string, highlights string",
    "gsm8k_reasoning": "row_id bigint, question string, generation string",
    "hk_o1aw": "row_id bigint, prompt string, thinking string, answer string",
    "kaist_cot": "row_id bigint, source string, rationale string, target string",
    "lima": "row_id bigint, conversations array<string>",
    "magpie_reasoning": (
        "row_id bigint, instruction string, response string, intent string, knowledge string, "
        "difficulty string, input_quality string, quality_explanation string, task_category string"
    ),
    "numina_math": "row_id bigint, problem string, solution string",
    "o1_journey": "row_id bigint, question string, longCOT string, answer string",
    "process_bench": (
        "row_id bigint, problem string, steps array<string>, label int, final_answer_correct boolean"
    ),
    "uhgeval": (
        "row_id bigint, headLine string, broadcastDate string, newsBeginning string, newsRemainder string"
    ),
}

PAIR = "row_id bigint, query string, response string"
QA = "row_id bigint, q string, a string"
