"""Key-value texts: segmentation by a key dictionary, and the filter and item fields made from it.

A text is a run of keys and values without separators. Keys are phrases of a dictionary; where one may start is
decided by the word behind it. That needs a scan from left to right, so segmentation is the one Python function here
(Arrow batches); everything derived from its pairs is built-in expressions.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import distinct_folded

# --- fixed values: keys by group, words that may begin a number or a schedule, values that say nothing -----------
KEYS = {
    "category": ("Вид услуги", "Тип услуги"),
    "content": (
        "Тип услуги автосервиса", "Услуга", "Название услуги", "Услуги", "Специальность", "Специальность или сфера",
        "Предмет или специальность", "Специализация", "Чем вы занимаетесь", "Направление", "Мероприятия", "Что перевозите",
        "Груз", "Техника", "Тип техники", "Вид техники", "Тип землеройной техники", "Тип коммунальной техники",
        "Тип дорожно-строительной техники", "Марка", "Марка авто", "Модель", "Производители", "Что декорируете",
        "Какими комнатами занимаетесь", "Какими жилыми помещениями занимаетесь", "Какими нежилыми помещениями занимаетесь",
        "Транспорт", "Кузов", "Тип кузова", "Способ погрузки", "Дополнительно", "Вид товара", "Тип товара",
        "Тип подъёмной техники", "Чем занимается исполнитель",
    ),
    "attribute": (
        "Кто оказывает услуги", "Где вы оказываете услуги", "Ваши клиенты", "Как вы работаете", "Занятия", "Преподаватель",
        "Формат", "Аудитория", "Куда выезжаете", "Где проводите занятия", "Где снимаете", "Для кого", "Средства для уборки",
        "Камера наблюдения в ремонтной зоне", "Можно со своими запчастями", "Состояние", "Тип двигателя", "Доступность",
        "Кому подойдёт место", "Класс авто", "Коробка передач", "Руль", "Вид транспорта", "Тип помещения", "Тип автосервиса",
        "Способ оплаты", "Поездка", "Инструменты", "Гости", "Число исполнителей", "Загрузка", "Машины", "Вид объявления",
        "Учебное учреждение", "Место сделки", "Тип детали кузова", "Выезжаете ли к заказчику", "Проживание на объекте",
        "Страховка", "Тип аренды", "Как внести", "Перевозка", "Тип объявления",
    ),
    "flag": (
        "Онлайн-запись", "Онлайн-показ", "Гарантия", "Гарантия на работу", "Гарантия на выполнение работ",
        "Работа по договору", "Предоплата", "Готов закупить материалы", "Закупка материалов", "Берёте ли срочные заказы",
        "Бесплатная консультация", "Работаете с юрлицами и ИП", "Работаете с НДС", "Преподаёт носитель языка",
        "Работа в праздники и выходные", "Выезд", "Выезд к клиенту", "Выезд за город", "Выезд в день заказа",
        "Выезд и доставка", "Работа с техникой премиум-класса", "С оператором", "Своя музыкальная аппаратура",
        "Есть портфолио", "Готовность к командировкам", "Доставка", "Техническая поддержка сайта", "Подбираете ли студию",
        "Составление сценария", "Создание образа", "Печать фотокниги", "Детское кресло", "Дополнительный водитель",
        "Есть лимит пробега", "Цена с НДС", "Возможность выкупить авто",
    ),
    "numeric": (
        "Стоимость", "Цена", "Начальная цена", "Тип стоимости", "Продолжительность", "Опыт работы", "Бригада",
        "Выполняю заказы", "Минимальная сумма заказа", "Минимальное время заказа", "Минимальное количество суток",
        "Грузоподъёмность", "Длина груза", "Ширина груза", "Число грузчиков", "Число мест", "Исполнителей в команде",
        "Площадь объекта", "Депозит", "Залог", "Год окончания", "Доплата за срочность", "Минимальное время аренды",
        "Расстояние доставки", "Срок выполнения заказа", "Минимальный возраст водителя", "Минимальный стаж вождения",
        "Через сколько дней возвращается", "Цена, ₽", "Сколько человек может участвовать", "Сколько гостей готовы снимать",
    ),
    "schedule": (
        "График работы", "График работы, дни недели", "Время работы,", "Время для связи", "Время для связи,",
        "Время для связи, дни недели", "Рабочие дни", "Дни",
    ),
    "address": ("Место оказания услуг", "Метро", "Районы"),
    "meta": (
        "Признак предзаполнения прайс листа", "Признак мигрированного прайс листа", "Провайдер Календарей бронирования",
        "ID узла дерева навигации", "Видеофайлы",
    ),
    "search": (
        "Рейтинг пользователя", "Срочная услуга (мультистатус)", "Поиск по слотам", "Сортировка для URL", "Участие в пилоте",
        "Открытие в сегменте", "Слова в описании", "Без депозита",
    ),
}
SMALL_WORDS = ("от", "до", "с", "за", "больше", "меньше", "более", "менее", "пн", "вт", "ср", "чт", "пт", "сб", "вс")
FLAG_VALUES = ("Да", "Нет")
FREE_TEXT_KEYS = ("Слова в описании",)
PLACEHOLDERS = ("", "Своя услуга", "Другое", "Другой", "Другая", "Свой")
CATEGORY, SUBCATEGORY, SUBJECT, BOOKING = "Вид услуги", "Тип услуги", "Предмет или специальность", "Онлайн-запись"
NO_CATEGORY, NO_SUBCATEGORY, NO = "No category", "No subcategory", "Нет"
# ----------------------------------------------------------------------------------------------------------------

PAIRS = T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())]))


class Segmenter:
    """Cuts texts into (key, value) pairs by a dictionary of keys by group."""

    def __init__(self, keys: dict[str, tuple[str, ...]] = KEYS):
        self.group = {k: g for g, own in keys.items() for k in own}
        self.small = re.compile(rf"(?:{'|'.join(SMALL_WORDS)})\.?")
        self.tree: dict = {}
        for key in self.group:
            node = self.tree
            for word in key.split():
                node = node.setdefault(word, {})
            node[""] = key  # words are never empty, so this marks an end

    def may_precede(self, key: str, word: str | None) -> bool:
        """Whether the key may stand before this word: a key's words inside a value are followed by small letters."""
        if word is None or word[0].isupper() or not word[0].isalpha():
            return True
        kind = self.group[key]
        if kind in ("numeric", "schedule"):
            return self.small.fullmatch(word) is not None
        return kind in ("address", "meta") or key in FREE_TEXT_KEYS

    def key_at(self, words: list[str], at: int) -> tuple[str | None, int]:
        """The longest key that may start here, and where it ends."""
        node, best, end, i = self.tree, None, at, at
        while i < len(words) and words[i] in node:
            node = node[words[i]]
            i += 1
            if "" in node and self.may_precede(node[""], words[i] if i < len(words) else None):
                best, end = node[""], i
        return best, end

    def pairs(self, text: str | None) -> list[tuple[str | None, str]]:
        words = text.split() if isinstance(text, str) else []
        out: list[tuple[str | None, list[str]]] = [(None, [])]
        at = 0
        while at < len(words):
            key, end = self.key_at(words, at)
            if key is None:
                out[-1][1].append(words[at])
                at += 1
                continue
            out.append((key, []))
            at = end
            if self.group[key] == "flag":  # takes a yes or no at most; what follows belongs to no key
                if at < len(words) and words[at] in FLAG_VALUES:
                    out[-1][1].append(words[at])
                    at += 1
                out.append((None, []))
        return [(k, " ".join(v)) for k, v in out if k is not None or v]


SEGMENTER = Segmenter()


@F.pandas_udf(PAIRS)
def split_params(texts: pd.Series) -> pd.Series:
    return pd.Series([[{"key": k, "value": v} for k, v in SEGMENTER.pairs(t)] for t in texts])


@F.udtf(returnType="key string, value string")
class ParamRows:
    """The same as a table function: one row per pair."""

    def eval(self, text: str):
        yield from SEGMENTER.pairs(text)


def values_of(pairs: Column, key: str) -> Column:
    """Distinct non-empty values of a key."""
    return distinct_folded(F.transform(F.filter(pairs, lambda p: p["key"] == key), lambda p: p["value"]))


def has_key(pairs: Column, key: str) -> Column:
    return F.coalesce(F.exists(pairs, lambda p: p["key"] == key), F.lit(False))


def flag_is_set(pairs: Column, key: str) -> Column:
    return F.coalesce(F.exists(pairs, lambda p: (p["key"] == key) & (p["value"] != NO)), F.lit(False))


def level_values(pairs: Column, key: str, marker: str) -> Column:
    """A level of the hierarchy has three states: its values, [marker] for a key without value, [] without the key."""
    values = values_of(pairs, key)
    none = F.when(has_key(pairs, key), F.array(F.lit(marker))).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(values) > 0, values).otherwise(none)


def params_text(pairs: Column) -> Column:
    """Values of category and content keys that say something, distinct, joined with '; '."""
    told = F.filter(pairs, lambda p: p["key"].isin(*KEYS["category"], *KEYS["content"]) & ~p["value"].isin(*PLACEHOLDERS))
    return F.array_join(distinct_folded(F.transform(told, lambda p: p["value"])), "; ")


def search_filters(pairs: Column) -> dict[str, Column]:
    return {
        "filter_category": F.get(level_values(pairs, CATEGORY, NO_CATEGORY), F.lit(0)),
        "filter_subcategory": level_values(pairs, SUBCATEGORY, NO_SUBCATEGORY),
        "filter_subject": values_of(pairs, SUBJECT),
        "filter_online_booking": flag_is_set(pairs, BOOKING),
    }


def item_params(pairs: Column) -> dict[str, Column]:
    return {
        "item_category": F.get(level_values(pairs, CATEGORY, NO_CATEGORY), F.lit(0)),
        "item_subcategory": F.get(level_values(pairs, SUBCATEGORY, NO_SUBCATEGORY), F.lit(0)),
        "item_subjects": values_of(pairs, SUBJECT),
        "item_online_booking": flag_is_set(pairs, BOOKING),
        "item_params_text": params_text(pairs),
    }


def _with_fields(df: DataFrame, column: str, fields) -> DataFrame:
    parsed = df.withColumn("_pairs", split_params(F.col(column)))
    return parsed.withColumns(fields(F.col("_pairs"))).drop("_pairs")


def process_queries(df: DataFrame, column: str = "search_infm_params_text") -> DataFrame:
    """df with the filter_* columns of a query's parameter text."""
    return _with_fields(df, column, search_filters)


def process_items(df: DataFrame, column: str = "item_infm_params_text") -> DataFrame:
    """df with the item_* columns of an item's parameter text."""
    return _with_fields(df, column, item_params)
