"""Column functions over replies, prompts, code and logs.

White space is Python's, which is wider than the JVM's; see ``SPACE``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as white space, as the inside of a character class of either engine.
SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
# How an answer is written.
BOXED = rf"\\boxed[{SPACE}]*\{{[{SPACE}]*([0-9,]+)[{SPACE}]*\}}"
STATED = rf"final[{SPACE}]+answer[{SPACE}]+is[{SPACE}]*[:{SPACE}]*([0-9,]+)"
STATED_STRICT = rf"final[{SPACE}]+answer[{SPACE}]+is[{SPACE}]*([0-9,]+)"
CODE_BLOCK = rf"(?s)```python[{SPACE}]*\n(.*?)```"
THINK = r"(?s)<think>.*?</think>"
ANSI = r"\x1b\[[0-9;]*m"
# Texts that outputs are wrapped in.
NO_OUTPUT = {"plain": "[No output — use print() to see results.]", "tool": "[WARN] No output. Use print() to see results."}
FEEDBACK = ("Code execution output:\n```\n", "\n```\nContinue solving based on these results. Put your final integer answer (0-99999) in \\boxed{}.")
NUDGE = "Continue solving. Write Python code if you need to compute something, or put your final integer answer in \\boxed{}."


#: The same characters one by one.
_SPACES = "".join(map(chr, [*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(_SPACES))


def strip_right(text: Column) -> Column:
    return F.rtrim(text, F.lit(_SPACES))


def last_match(text: Column, pattern: str, group: int = 1) -> Column:
    """The last match of a pattern, not the best one; null where there is none."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.lit(-1))


def in_range(value: Column, most: int = 99_999) -> Column:
    return value.between(0, most)


def _answer(digits: Column) -> Column:
    number = F.regexp_replace(digits, ",", "").try_cast("decimal(38,0)")
    return F.when(in_range(number), number.cast("int"))


def extract_answer(text: Column, variant: str = "colon") -> Column:
    """The answer that a reply ends with: the last boxed number, else the last stated one; each is
    dropped if outside 0-99999. ``variant`` "colon" allows a colon before a stated number."""
    stated = STATED if variant == "colon" else STATED_STRICT
    return F.coalesce(_answer(last_match(text, f"(?iu){BOXED}")), _answer(last_match(text, f"(?iu){stated}")))


def strip_think(text: Column) -> Column:
    """Without closed think blocks; one that is not closed stays."""
    return strip(F.regexp_replace(text, THINK, ""))


def extract_code_blocks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CODE_BLOCK), F.lit(1))


def answer_clean_or_raw(reply: Column, zero_is_answer: bool = False) -> Column:
    """Answer outside think blocks, else anywhere. An outer 0 gives way to the whole reply, as in the
    voting that this feeds, unless ``zero_is_answer``."""
    clean = extract_answer(strip_think(reply))
    return F.coalesce(clean if zero_is_answer else F.nullif(clean, F.lit(0)), extract_answer(reply))


def code_clean_or_raw(reply: Column) -> Column:
    clean = extract_code_blocks(strip_think(reply))
    return F.when(F.size(clean) > 0, clean).otherwise(extract_code_blocks(reply))


def wrap_reasoning(reasoning: Column, content: Column) -> Column:
    content = F.coalesce(content, F.lit(""))
    return F.when(F.coalesce(reasoning, F.lit("")) != "", F.concat(F.lit("<think>"), reasoning, F.lit("</think>\n"), content)).otherwise(content)


def first_nonempty(*columns: Column) -> Column:
    """The first that is neither null nor empty; '' where there is none."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns), F.lit(""))


def text_preview(text: Column, n: int = 300) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def append_suffix(text: Column, suffix: str) -> Column:
    return F.concat(text, F.lit(" " + suffix))


def strip_ansi(text: Column) -> Column:
    return F.regexp_replace(text, ANSI, "")


def filter_traceback(frames: Column, variant: str = "tool") -> Column:
    """Frames without colours; "tool" drops those of files other than cells and joins with nothing,
    "plain" keeps all and joins lines."""
    clean = F.transform(frames, strip_ansi)
    if variant == "plain":
        return F.array_join(clean, "\n")
    return F.array_join(F.filter(clean, lambda f: ~(f.contains('File "') & ~f.contains("ipython-input"))), "")


def ensure_trailing_newline(text: Column) -> Column:
    return F.when(text.endswith("\n"), text).otherwise(F.concat(text, F.lit("\n")))


def format_exec_output(stdout: Column, stderr: Column, variant: str = "plain") -> Column:
    """One text of what a run wrote, or a note that it wrote nothing."""
    out, err = F.coalesce(stdout, F.lit("")), F.coalesce(stderr, F.lit(""))
    if variant == "plain":
        out, err = strip_right(out), strip_right(err)
        return F.when((err != "") & (out != ""), F.concat(out, F.lit("\n"), err)).when(err != "", err).when(out != "", out).otherwise(F.lit(NO_OUTPUT["plain"]))
    return (
        F.when((err != "") & (out != ""), F.concat(strip_right(out), F.lit("\n"), err))
        .when(err != "", err)
        .when(strip(out) != "", out)
        .otherwise(F.lit(NO_OUTPUT["tool"]))
    )


def join_exec_outputs(outputs: Column) -> Column:
    return F.concat(F.lit(FEEDBACK[0]), F.array_join(outputs, "\n---\n"), F.lit(FEEDBACK[1]))


def ensure_last_print(code: Column) -> Column:
    """Print the last line's value, unless it is empty, a comment, or has print or import in it."""
    lines = F.split(strip(code), "\n")
    last = strip(F.try_element_at(lines, F.lit(-1)))
    keep = last.contains("print") | last.contains("import") | (last == "") | last.startswith("#")
    head = F.slice(lines, F.lit(1), F.size(lines) - 1)
    return F.when(keep, code).otherwise(F.array_join(F.concat(head, F.array(F.concat(F.lit("print("), last, F.lit(")")))), "\n"))


def is_tool_error(output: Column) -> Column:
    return output.startswith("[ERROR]") | output.contains("Traceback")


def split_problems(text: Column, least: int = 20) -> Column:
    """Array of (num, problem): what follows each "Problem N", up to its answer or solution."""
    numbers = F.regexp_extract_all(text, F.lit(rf"\bProblem[{SPACE}]+([0-9]+)\b"), F.lit(1))
    bodies = F.split(text, rf"\bProblem[{SPACE}]+[0-9]+\b")
    bodies = F.slice(bodies, F.lit(2), F.greatest(F.size(bodies) - 1, F.lit(0)))

    def cut(body: Column) -> Column:
        for marker in ("Answer:", "Solution:"):
            body = strip(F.substring_index(strip(body), marker, 1))
        return F.regexp_replace(body, rf"(?i)\AProblem:[{SPACE}]*", "")

    pairs = F.zip_with(numbers, bodies, lambda n, b: F.struct(n.try_cast("int").alias("num"), cut(b).alias("problem")))
    return F.filter(pairs, lambda p: F.length(p["problem"]) > least)


PROBLEM_BLOCK = rf"(?s)Problem[{SPACE}]+([0-9]+)[{SPACE}]*[.\n][{SPACE}]*Problem:[{SPACE}]*(.*?)(?=\nAnswer:|\nSolution:)"


def extract_problem_blocks(text: Column, least: int = 30) -> Column:
    """Array of (id, problem) of labelled blocks that an answer or solution follows."""
    numbers, bodies = (F.regexp_extract_all(text, F.lit(PROBLEM_BLOCK), F.lit(g)) for g in (1, 2))
    pairs = F.zip_with(numbers, bodies, lambda n, b: F.struct(problem_id(n.try_cast("int")).alias("id"), strip(b).alias("problem")))
    return F.filter(pairs, lambda p: F.length(p["problem"]) > least)


def problem_id(num: Column) -> Column:
    return F.format_string("prob_%02d", num)


def run_name(model: Column, at: Column) -> Column:
    return F.concat(F.date_format(at, "yyyyMMdd_HHmmss"), F.lit("_"), F.replace(F.substring_index(model, "/", -1), F.lit(".gguf"), F.lit("")))


def chat_reply(response: Column) -> Column:
    """The text of a chat response in JSON, its reasoning wrapped."""
    message = F.from_json(response, "choices array<struct<message:struct<content:string,reasoning_content:string>>>")["choices"][0]["message"]
    return wrap_reasoning(message["reasoning_content"], message["content"])
