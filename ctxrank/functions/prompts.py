"""Prompt templates and the expressions that fill them.

A filled prompt is a plain concatenation around the slots, never a format
call, so percent signs and braces in a document stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ctxrank.functions.text import break_before_content

# The wording of every prompt. A slot is written {}.
ANSWER_PASSAGE = (
    "Please write a passage to answer the question.\n"
    "Question: {}\n"
    "End your passage with ####\n"
    "Passage:"
)
CLAIM_PASSAGE = (
    "Please write a scientific paper passage to support/refute the claim.\n"
    "Claim: {}\n"
    "End your passage with ####\n"
    "Passage:"
)
COUNTER_ARGUMENT = (
    "Please write a counter argument for the passage.\n"
    "Passage: {}\n"
    "End your passage with ####\n"
    "Counter Argument:"
)
SCIENTIFIC_PASSAGE = (
    "Please write a scientific paper passage to answer the question.\n"
    "Question: {}\n"
    "End your passage with ####\n"
    "Passage:"
)
FINANCIAL_PASSAGE = (
    "Please write a financial article passage to answer the question.\n"
    "Question: {}\n"
    "End your passage with ####\n"
    "Passage:"
)
NEWS_PASSAGE = (
    "Please write a news passage about the topic.\n"
    "Topic: {}\n"
    "End your passage with ####\n"
    "Passage:"
)
PASSAGE_IN_LANGUAGE = (
    "Please write a passage in {} to answer the question in detail.\n"
    "Question: {}\n"
    "End your passage with ####\n"
    "Passage:"
)
ANSWER_TEMPLATE = (
    "\n"
    "Given a query: {},\n"
    "\n"
    "please write a very short template for the answer.\n"
    "\n"
    "\n"
    "Use ... as placeholders for the key information.\n"
    " \n"
    "End your passage with ####\n"
    "\n"
)
PASSAGE_QUESTIONS = (
    "Which kinds of questions can be answered based on the following passage:\n"
    "\n"
    "```<passage>{}\n"
    "</passage>```\n"
    "Questions must be very short, different, and be written on separate lines.\n"
    "If the passage provides no meaningful content, respond with a 'No Content'.\n"
    "\n"
)
PASSAGE_STATEMENTS = (
    "Please provide succinct statements that can be backed up by the following passage.\n"
    "\n"
    "```<passage>{}\n"
    "</passage>```\n"
    "Write the statements on separate lines.\n"
    "Avoid referencing any identifiers that directly point to the text provided or the"
    " statement you generate.\n"
)
PASSAGE_TOPICS = (
    "Which topics could the 'Content' section of the following passage be arguing about.\n"
    "If the 'Content' section provides no meaningful argument, respond with a single"
    " 'No content'.\n"
    "```<passage>\n"
    "{}\n"
    "</passage>```\n"
    "Topics are questions.\n"
    "Each question must be very short, different, and be written on separate lines.\n"
    "Do not mention the passage itself or the author of the passage..\n"
    "\n"
)
REPHRASE = (
    "Rephrase the following text. Try to use words as different as possible.\n"
    "\n"
    "\n"
    "{}\n"
    "\n"
    "\n"
)
ADD_IRRELEVANT = (
    "Add a few irrelevant words before the following texts but try not to change the main"
    " subject.\n"
    "\n"
    "\n"
    "{}\n"
    "\n"
    "\n"
)
ASSISTANT_RULES = (
    "\n"
    "You are an AI assistant. Here are some rules you always follow:\n"
    "- Generate human readable output, avoid creating output with gibberish text.\n"
    "- Don't plainly replicate the given instruction.\n"
    "- Generate only the requested output, don't include any other language before or after"
    " the requested output.\n"
    "- Never say thank you, that you are happy to help, that you are an AI agent, etc. Just"
    " answer directly.\n"
    "- Generate professional language typically used in business documents in North America.\n"
    "- Never generate offensive or foul language\n"
)
INSTRUCTION_WRAPPER = (
    "<s>[INST]\n"
    "You are an AI assistant. Here are some rules you always follow:\n"
    "- Generate human readable output, avoid creating output with gibberish text.\n"
    "- Don't plainly replicate the given instruction.\n"
    "- Generate only the requested output, don't include any other language before or after"
    " the requested output.\n"
    "- Never say thank you, that you are happy to help, that you are an AI agent, etc. Just"
    " answer directly.\n"
    "- Generate professional language typically used in business documents in North America.\n"
    "- Never generate offensive or foul language.\n"
    "\n"
    "The user prompt is as follows:\n"
    "\n"
    "{}[/INST]</s>\n"
)

# The template each task uses.
TASKS = {
    "template": ANSWER_TEMPLATE,
    "web search": ANSWER_PASSAGE,
    "web-search": ANSWER_PASSAGE,
    "scifact": CLAIM_PASSAGE,
    "arguana": COUNTER_ARGUMENT,
    "trec-covid": SCIENTIFIC_PASSAGE,
    "fiqa": FINANCIAL_PASSAGE,
    "dbpedia-entity": ANSWER_PASSAGE,
    "trec-news": NEWS_PASSAGE,
    "mr-tydi": PASSAGE_IN_LANGUAGE,
    "questions1": PASSAGE_QUESTIONS,
    "questions2": PASSAGE_QUESTIONS,
    "questions2_news": PASSAGE_QUESTIONS,
    "questions2_covid": PASSAGE_QUESTIONS,
    "questions2_scidocs": PASSAGE_STATEMENTS,
    "questions2_cqadupstack": PASSAGE_QUESTIONS,
    "questions2_touche2020": PASSAGE_TOPICS,
    "rephrase": REPHRASE,
    "irrelevant": ADD_IRRELEVANT,
}

# The question task of each topic set that has its own.
TOPIC_TASKS = {
    "beir-v1.0.0-scidocs-test": "questions2_scidocs",
    "beir-v1.0.0-trec-news-test": "questions2_news",
    "beir-v1.0.0-trec-covid-test": "questions2_covid",
    "beir-v1.0.0-cqadupstack-android-test": "questions2_cqadupstack",
    "beir-v1.0.0-webis-touche2020-test": "questions2_touche2020",
}


def fill(template: str, *values: Column) -> Column:
    """Concatenate ``values`` into the slots of ``template``."""
    first, *rest = template.split("{}")
    if len(rest) != len(values):
        raise ValueError(f"template has {len(rest)} slots, got {len(values)} values")
    parts = [F.lit(first)]
    for value, text in zip(values, rest):
        parts += [value, F.lit(text)]
    return F.concat(*parts)


def question_task(topic: str) -> str:
    """The question-writing task for a topic set."""
    return TOPIC_TASKS.get(topic, "questions2")


def build_prompt(
    text: Column, task: str | None, wrapper: str | None = None, language: str = "en"
) -> Column:
    """The prompt of ``task`` for ``text``, optionally inside a wrapper template.

    Without a task the text itself is the prompt.
    """
    if task is None:
        prompt = text
    elif task not in TASKS:
        raise ValueError(f"task {task!r} is not supported")
    elif task == "mr-tydi":
        prompt = fill(TASKS[task], F.lit(language), text)
    elif task == "questions2_touche2020":
        prompt = fill(TASKS[task], break_before_content(text))
    else:
        prompt = fill(TASKS[task], text)
    return prompt if wrapper is None else fill(wrapper, prompt)


def chat_messages(prompt: Column, system: str = ASSISTANT_RULES) -> Column:
    """System and user message of a chat call."""
    return F.array(
        F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")),
        F.struct(F.lit("user").alias("role"), prompt.alias("content")),
    )
