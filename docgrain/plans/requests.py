"""Requests to a model server and what its replies mean, as column expressions on JSON."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import LANGUAGES, language_name, trim

# The request formats that model families prescribe, by name; '' is the default.
TRANSLATION_REQUEST = (
    "You are a professional {{.SourceLangName}} ({{.SourceLang}}) to {{.TargetLangName}} ({{.TargetLang}}) translator. "
    "Your goal is to accurately convey the meaning and nuances of the original {{.SourceLangName}} text while adhering to "
    "{{.TargetLangName}} grammar, vocabulary, and cultural sensitivities.\nProduce only the {{.TargetLangName}} translation, "
    "without any additional explanations or commentary. Please translate the following {{.SourceLangName}} text into "
    "{{.TargetLangName}}:\n\n\n{{.User}}"
)
TEMPLATES = {
    "": "<start_of_turn>user\n{{.System}}\n\n{{.User}}<end_of_turn>\n<start_of_turn>model\n",
    "translategemma": f"<start_of_turn>user\n{TRANSLATION_REQUEST}<end_of_turn>\n<start_of_turn>model\n",
}
USER_TEMPLATES = {
    "gemma3-translator": "Translate from {{.SourceLangName}} to {{.TargetLangName}}: {{.User}}",
    "translategemma": TRANSLATION_REQUEST,
}
STOP = ("<end_of_turn>",)
FIELDS = ("System", "User", "SourceLang", "TargetLang", "SourceLangName", "TargetLangName")


@dataclass
class Config:
    """Where and how requests go. The token is read from the environment only, and never shown."""

    model: str = ""
    url: str = "http://localhost:11434/v1"
    transport: str = "chat"
    prompt_template: str = ""
    user_template: str = ""
    stop: tuple[str, ...] = ()
    reasoning: str = ""
    timeout_s: float = 300.0
    token: str = field(default="", repr=False)

    @classmethod
    def from_env(cls, prefix: str = "DOCGRAIN_LLM_") -> Config:
        get = lambda k, d="": os.environ.get(prefix + k, d)
        base = cls()
        return cls(get("MODEL"), get("URL", base.url), get("TRANSPORT", "chat"), get("PROMPT_TEMPLATE"), get("USER_TEMPLATE"),
                   tuple(x for x in get("STOP").split(",") if x), get("REASONING"), float(get("TIMEOUT", "300")), get("TOKEN"))

    @property
    def ready(self) -> bool:
        return bool(self.model)

    def describe(self) -> str:
        return f"{self.model or 'no model'} at {self.url} ({self.transport})" + (", with a token" if self.token else "")


def fill_template(template: str, values: dict[str, str]) -> str:
    """:func:`render_template` for one request, on the side that sends it."""
    return re.sub(r"\{\{\s*\.(\w+)\s*\}\}", lambda m: values.get(m[1], ""), template)


def field_values(system: str, user: str, source: str, target: str) -> dict[str, str]:
    source = source or "en"
    names = [LANGUAGES.get(x.strip().lower(), x.strip()) for x in (source, target)]
    return dict(zip(FIELDS, (system, user, source, target, *names)))


def render_template(template: Column, values: dict[str, Column]) -> Column:
    """A template with its ``{{.Field}}`` marks filled in one pass; no control flow."""
    rx = r"\{\{\s*\.(\w+)\s*\}\}"
    known = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.coalesce(v, F.lit("")))])
    names = F.regexp_extract_all(template, F.lit(rx), F.lit(1))
    put = F.transform(
        F.split(template, rx, -1),
        lambda s, i: F.concat(s, F.coalesce(F.try_element_at(known, F.get(names, i)), F.lit(""))),
    )
    return F.concat_ws("", put)


def request_body(config: Config, system: Column, user: Column, source: Column, target: Column) -> Column:
    """The JSON body of a request for the configured transport; fields without a value are left out."""
    src = F.when(F.coalesce(source, F.lit("")) == "", "en").otherwise(source)
    values = dict(zip(FIELDS, (system, user, src, target, language_name(src), language_name(target))))
    if config.transport == "completions":
        template = TEMPLATES.get(config.prompt_template.strip(), config.prompt_template)
        stop = F.array(*map(F.lit, config.stop or STOP))
        return F.to_json(F.struct(
            F.lit(config.model).alias("model"), render_template(F.lit(template), values).alias("prompt"),
            F.lit(0).alias("temperature"), F.lit(False).alias("stream"), stop.alias("stop"),
        ))

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    messages = F.array(message("system", system), message("user", user))
    if config.user_template:
        template = USER_TEMPLATES.get(config.user_template.strip(), config.user_template)
        messages = F.array(message("user", render_template(F.lit(template), values)))
    reasoning = F.lit(config.reasoning.strip() or None).cast("string")
    return F.to_json(F.struct(
        F.lit(config.model).alias("model"), messages.alias("messages"), F.lit(0).alias("temperature"),
        F.lit(False).alias("stream"), reasoning.alias("reasoning_effort"),
    ))


REPLY = (
    "choices array<struct<message: struct<role: string, content: string>, text: string, finish_reason: string>>, "
    "error struct<message: string>"
)


def reply_outcome(status: Column, body: Column) -> Column:
    """(ok, text, error_kind) of a server's reply. Kinds: http, json, endpoint, no_choices, truncated, empty."""
    r = F.from_json(body, REPLY)
    first = F.get(r["choices"], F.lit(0))
    content = F.coalesce(F.when(first["message"]["content"] != "", first["message"]["content"]), first["text"], F.lit(""))
    broken = F.try_parse_json(body).isNull()
    kind = (
        F.when(status != 200, "http")
        .when(broken, "json")
        .when(r["error"].isNotNull(), "endpoint")
        .when(F.coalesce(F.size(r["choices"]), F.lit(0)) < 1, "no_choices")
        .when(~F.coalesce(first["finish_reason"], F.lit("")).isin("", "stop"), "truncated")
        .when(trim(content) == "", "empty")
    )
    return F.struct(kind.isNull().alias("ok"), F.when(kind.isNull(), content).alias("text"), kind.alias("error_kind"))


def fixed_terms(terms: Column) -> Column:
    """The end of a system prompt: the glossary lines that apply, in order; '' for none."""
    return F.when(F.size(terms) > 0, F.concat(F.lit("\n\nFixed terms:\n"), F.array_join(F.array_sort(terms), "\n"))).otherwise("")


def instruction(task: Column, rules: str, terms: Column | None = None) -> Column:
    """A system prompt: the task, the rules, and the glossary lines that apply, in order."""
    head = F.concat(task, F.lit("\n\n" + rules))
    return head if terms is None else F.concat(head, fixed_terms(terms))


def default_task(language: Column, unit: str) -> Column:
    name = language_name(F.coalesce(language, F.lit("")))
    return F.concat(F.lit(f"Translate {unit} into "), F.when(name == "", "the target language").otherwise(name), F.lit("."))


FRAGMENT_RULES = (
    "Answer with the result and nothing else. The text is part of a longer document: keep its sentences, and its emphasis. "
    "Marks such as ⟦0⟧ stand for things left out; repeat each once, as it is."
)
PART_RULES = (
    "Answer with the resulting Markdown and nothing else, without a fence round it. Keep all blocks, heading levels, list "
    "items and table rows in place. Marks such as ⟦0⟧ stand for things left out; repeat each once, as it is."
)
LIST_RULES = (
    "The lines are short labels of one table or list. Answer with the same numbers, a line each, in order, and add nothing. "
    "Marks such as ⟦0⟧ stand for things left out; repeat each once, as it is."
)
