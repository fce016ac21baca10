"""Fixed values.

Everything in this file has to equal what the data and its consumers already use
(tag names, field names, join text, markers, chat heads), so it is stated plainly.
"""

# --- names of the ten corpora, in registry order --------------------------------
CORPORA = (
    "cnn_daily_mail",
    "gsm8k_reasoning",
    "hk_o1aw",
    "kaist_cot",
    "lima",
    "magpie_reasoning",
    "numina_math",
    "o1_journey",
    "process_bench",
    "uhgeval",
)

# --- tiers ----------------------------------------------------------------------
TIERS = {
    "high": ("gsm8k_reasoning", "hk_o1aw", "lima", "o1_journey", "process_bench", "uhgeval"),
    "mid": ("cnn_daily_mail", "magpie_reasoning"),
    "low": ("kaist_cot", "numina_math"),
}
MASK_KINDS = {
    "poisson": ("uhgeval", "cnn_daily_mail"),
    "semantic": (
        "gsm8k_reasoning",
        "hk_o1aw",
        "lima",
        "o1_journey",
        "process_bench",
        "magpie_reasoning",
        "kaist_cot",
        "numina_math",
    ),
}

# --- tags kept from a tagged reasoning text -------------------------------------
REASONING_TAGS = ("thinking", "reasoning", "reflection", "adjustment", "output")

# --- fields of an annotated instruction row -------------------------------------
INSTRUCTION_FIELDS = (
    "instruction",
    "response",
    "intent",
    "knowledge",
    "difficulty",
    "input_quality",
    "quality_explanation",
    "task_category",
)

# --- text formats ---------------------------------------------------------------
ANSWER_JOIN = "\n\nFinal Answer:\n"
CHAIN_MARKER = "####"
STEPS_QUESTION_HEAD = "## Question\n\n"
STEPS_CHAIN_HEAD = "\n\n## CoT Reasoning"

# --- every code point Python's str.strip() removes ------------------------------
PYTHON_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# --- opening / closing brackets accepted around a reasoning tag -----------------
TAG_OPEN = "[<‹]"
TAG_END = "[>›]"
#: ``TAG_OPEN`` or ``TAG_CLOSE``, a name and ``TAG_END``, in a form that the matcher leaves at once at any other character
TAG_TOKEN = r"(?U)[<‹](?:/|(?<=<)/›)?\w+[>›]"
TAG_CLOSE = "(?:</|‹/|</›)"
