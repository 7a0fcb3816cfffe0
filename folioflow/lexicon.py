"""Words, types and limits of the document model. Fixed values stand together; a ``Lexicon`` can replace them."""

from __future__ import annotations

from dataclasses import dataclass

# Block types.
FURNITURE = ("PageHeader", "PageFooter", "Footnote")
MATH_BLOCKS = ("Equation", "Code")
FIGURE_GROUPS = ("PictureGroup", "FigureGroup")
IMAGE_BLOCKS = ("Picture", "Figure", "FigureGroup", "PictureGroup")
HEADER = "SectionHeader"

# Kinds of images that a description may name.
IMAGE_TYPES = ("граф", "дерево", "блок-схема", "диаграмма", "таблица", "псевдокод", "временная_сложность", "иллюстрация", "другое")

# Kinds of labelled passages; what ends a passage; word forms in references, with the noun they stand for.
LABEL_KINDS = ("определение", "теорема", "лемма", "аксиома", "следствие", "утверждение", "замечание", "пример", "алгоритм", "задача", "свойство", "доказательство")
STOP_WORDS = ("доказательство", "заметим", "покажем", "таким образом", "следовательно", "отсюда", "действительно", "вернёмся", "перейдём", "рассмотрим", "во многих", "многие")
REFERENCE_FORMS = (
    r"определени[иею]", r"теорем[еаы]", r"лемм[еаы]", r"аксиом[еаы]", r"следстви[иею]", r"утвержден[ии]", r"замечани[иею]", r"примере?",
    r"алгоритм[еа]", r"задач[еи]", r"свойств[еа]", r"доказательств[еа]", r"рис(?:унк[еа])?\.?",
)
EXTENDED_FORMS = (
    r"определени[иеюя]", r"теорем[еаыу]", r"лемм[еаыу]", r"аксиом[еаыу]", r"следстви[иеюя]", r"утверждени[иеюя]", r"замечани[иеюя]", r"пример[ау]?е?",
    r"алгоритм[еау]?", r"задач[еиау]", r"свойств[еау]", r"доказательств[еау]", r"рис(?:ун(?:ок|к[еау]))?\.?",
)
REFERENCE_NOUNS = (
    ("определени", "Определение"), ("теорем", "Теорема"), ("лемм", "Лемма"), ("аксиом", "Аксиома"), ("следстви", "Следствие"), ("утвержден", "Утверждение"), ("замечани", "Замечание"),
    ("пример", "Пример"), ("алгоритм", "Алгоритм"), ("задач", "Задача"), ("свойств", "Свойство"), ("доказательств", "Доказательство"), ("рис", "Рисунок"),
)


@dataclass(frozen=True)
class Lexicon:
    label_kinds: tuple[str, ...] = LABEL_KINDS
    stop_words: tuple[str, ...] = STOP_WORDS
    reference_forms: tuple[str, ...] = REFERENCE_FORMS
    reference_nouns: tuple[tuple[str, str], ...] = REFERENCE_NOUNS
    figure_noun: str = "Рисунок"
    figure_mark: str = r"рис(?:унок)?\.?\s*(\d+(?:\.\d+)*)"
    exercise_titles: tuple[str, ...] = ("Задачи", "Упражнения")
    exercise_items: tuple[str, ...] = ("Задача", "Упражнение")
    max_title: int = 15
    max_continuation: int = 6
    group_size: int = 10


STRICT = Lexicon()
#: Word forms that the strict list misses.
INTENDED = Lexicon(reference_forms=EXTENDED_FORMS)
