"""Chat frames: building, converting and cleaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexiloom.functions.text import LINE_BREAK, normalize, sanitize_ascii, sanitize_unicode, strip

# The tags of the two chat formats.
USER_TAG = "<|user|>"
ASSISTANT_TAG = "<|assistant|>"
END_TAG = "<|end|>"
PAD = "<pad>"
IM_START = "<|im_start|>"
IM_END = "<|im_end|>"


def legacy_prompt(text: Column) -> Column:
    return F.concat_ws(" ", F.lit(USER_TAG), sanitize_ascii(text), F.lit(ASSISTANT_TAG))


def legacy_sample(user: Column, assistant: Column) -> Column:
    return F.concat_ws(" ", F.lit(USER_TAG), user, F.lit(ASSISTANT_TAG), assistant, F.lit(END_TAG))


# Stands for all that is between a prompt and its reply.
TURN = "\x1f"


def close_turn(text: Column) -> Column:
    """A framed text whose tags between prompt and reply are one sign: ``TURN``, or ``IM_START`` in ``im`` frames.

    A model of few tokens of context then sees the prompt's last words when it starts its reply.
    """
    legacy = F.regexp_replace(text, rf" ?\Q{ASSISTANT_TAG}\E ?", TURN)
    return F.replace(legacy, F.lit(f"{IM_END}\n{IM_START}assistant\n"), F.lit(IM_START))


def im_prompt(text: Column) -> Column:
    return F.concat(
        F.lit(f"{IM_START}user\n"), sanitize_unicode(text), F.lit(f"{IM_END}\n{IM_START}assistant\n")
    )


def im_sample(user: Column, assistant: Column) -> Column:
    return F.concat(
        F.lit(f"{IM_START}user\n"),
        user,
        F.lit(f"{IM_END}\n{IM_START}assistant\n"),
        assistant,
        F.lit(IM_END),
    )


def _quoted(tag: str) -> str:
    return rf"\Q{tag}\E"


def is_legacy_chat(text: Column) -> Column:
    return text.contains(USER_TAG) & text.contains(ASSISTANT_TAG)


def is_chat(text: Column) -> Column:
    """Either frame, by its tags alone."""
    return is_legacy_chat(text) | (text.contains(IM_START) & text.contains("assistant"))


def convert_legacy(text: Column) -> Column:
    """Legacy frame to ``im`` frame.

    Rows without both tags pass unchanged; rows whose assistant tag only comes before the user
    tag have no reply and become NULL.
    """
    after_user = F.get(F.split(text, _quoted(USER_TAG), 2), F.lit(1))
    halves = F.split(after_user, _quoted(ASSISTANT_TAG), 2)
    reply = F.substring_index(F.get(halves, F.lit(1)), END_TAG, 1)
    return F.when(~is_legacy_chat(text), text).when(
        F.size(halves) == 2, im_sample(normalize(F.get(halves, F.lit(0))), normalize(reply))
    )


def cut_at_end_tag(text: Column) -> Column:
    return F.substring_index(text, END_TAG, 1)


def clean_reply(text: Column) -> Column:
    """Opening and padding tags become spaces, text from the closing tag on is dropped."""
    spaced = F.replace(F.replace(text, F.lit(IM_START), F.lit(" ")), F.lit(PAD), F.lit(" "))
    return strip(F.substring_index(spaced, IM_END, 1))


def first_reply(output: Column, prefix: str) -> Column:
    """Text of the first output line that starts with ``prefix``, stripped and lowered; else NULL."""
    pattern = rf"(?:^|[{LINE_BREAK}])\Q{prefix}\E([^{LINE_BREAK}]*)"
    return F.when(
        F.regexp_like(output, F.lit(pattern)),
        F.lower(strip(F.regexp_extract(output, pattern, 1))),
    )


def last_reply_ids(output: Column, prefix: str) -> Column:
    """Numbers on the last output line that starts with ``prefix``; NULL where no line does."""
    pattern = rf"(?s)^(?:.*[{LINE_BREAK}])?\Q{prefix}\E([^{LINE_BREAK}]*)"
    payload = strip(F.regexp_extract(output, pattern, 1))
    parts = F.filter(F.split(payload, r"\s+"), lambda p: p != "")
    return F.when(
        F.regexp_like(output, F.lit(pattern)), F.transform(parts, lambda p: p.try_cast("int"))
    )
