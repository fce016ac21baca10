"""Wording of mask descriptions and layouts.

Texts are made from a few rules: a description is a request verb before what is asked for,
a layout is a heading style and a separator around named parts.  Each operator takes a
``Wording``; ``worded`` makes one from other verbs, styles or speaker names, and any field
can be given outright.  ``{}`` marks the places that a layout fills.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from quillweave.functions import fixed

VERBS = ("Supply", "Write out")
#: heading styles: how a part's name goes before its text
STYLES = ("{name}: {}", "== {name} ==\n{}")
SEPARATORS = ("\n", "\n\n")
SPEAKERS = ("Asker", "Helper")


def requests(thing: str, verbs: Sequence[str] = VERBS) -> tuple[str, ...]:
    return tuple(f"{verb} {thing}." for verb in verbs)


def layouts(
    names: Sequence[str], *, end: str = "", styles: Sequence[str] = STYLES, separators: Sequence[str] = SEPARATORS
) -> tuple[str, ...]:
    """One layout for each style and separator."""
    return tuple(
        between.join(style.replace("{name}", name) for name in names) + end for style in styles for between in separators
    )


@dataclass(frozen=True)
class Wording:
    # spans: the two descriptions a random-span mask may carry
    span_plain: str
    span_numbered: str
    # tagged reasoning: one description per tag, in tag order
    tag_desc: tuple[str, ...]
    # reasoning between a prompt and its answer: prompt, mask, answer
    between_desc: tuple[str, ...]
    between_layout: tuple[str, ...]
    # rationale and target: lead-in text and description (None: no description)
    rationale_lead: tuple[tuple[str, str | None], ...]
    target_lead: tuple[tuple[str, str | None], ...]
    # dialogue: two places per layout, first and second speaker
    dialogue_layout: tuple[str, ...]
    # annotated instruction rows: opening line and one description per field
    fields_head: str
    field_desc: tuple[str, ...]
    # problem and solution: problem, mask
    solution_desc: tuple[str, ...]
    solution_layout: tuple[str, ...]
    # chain and answer
    chain_desc: tuple[str, ...]
    answer_desc: tuple[str, ...]
    # steps
    step_desc: tuple[str, ...]
    # request built around one blank
    request_before: str
    request_after: str


def worded(verbs: Sequence[str] = VERBS, speakers: Sequence[str] = SPEAKERS, **layout) -> Wording:
    """A wording from its rules; ``layout`` goes to ``layouts`` (styles, separators)."""

    def leads(thing: str, name: str) -> tuple[tuple[str, str | None], ...]:
        return tuple(("\n", r) for r in requests(thing, verbs)) + ((f"\n{name} - ", None),)

    return Wording(
        span_plain=requests("what is missing", verbs)[0],
        span_numbered=requests("the part with this number", verbs)[-1],
        tag_desc=tuple(f"Contents of the section {name!r}." for name in fixed.REASONING_TAGS),
        between_desc=requests("the reasoning from the question to the answer", verbs),
        between_layout=layouts(("Question", "Reasoning", "Answer"), **layout),
        rationale_lead=leads("the grounds for the answer", "Grounds"),
        target_lead=leads("the answer", "Answer"),
        dialogue_layout=layouts(speakers, end="\n", **layout),
        fields_head="A record in which some values may be blank:\n",
        field_desc=tuple(f"Value of {name!r} in this record." for name in fixed.INSTRUCTION_FIELDS),
        solution_desc=requests("a worked solution", verbs),
        solution_layout=layouts(("Task", "Worked solution"), **layout),
        chain_desc=requests("the whole train of thought", verbs),
        answer_desc=requests("the answer it ends in", verbs),
        step_desc=requests("the step that comes here", verbs),
        request_before="Text to complete: ",
        request_after=" (end of text)",
    )


DEFAULT = worded()
