"""Wording, labels and patterns that results must equal."""

KEYWORDS = (
    "Computer vision",
    "Data Analyst",
    "Data Engineer",
    "Data Science",
    "Data Scientist",
    "ML Engineer",
    "MLOps инженер",
    "AI",
    "Product Manager",
    "Python Developer",
    "Web Analyst",
    "Аналитик данных",
    "Бизнес-аналитик",
    "Системный аналитик",
    "Финансовый аналитик",
    "ML",
    "Deep Learning",
    "NLP",
    "LLM",
    "Project Manager",
    "Product Owner",
    "Time series",
)
CITIES = {"Москва": 1}

NO_EXPERIENCE = "нет опыта"
ONE_TO_THREE = "от 1 до 3 лет"
THREE_TO_SIX = "от 3 до 6 лет"
MORE_THAN_SIX = "более 6 лет"
MORE_WORD = "более"

NO_SALARY = "з/п не указана"
NO_EXPERIENCE_LABEL = "Не указан"
UNKNOWN_INDUSTRY = "Unknown"

PROFILE_WORK = "Опыт и обязанности: "
PROFILE_TAGS = "Навыки: "
PROFILE_LEVEL = "Опыт: "

KEPT_CHARACTERS = "a-zа-я0-9"
TAG_VERBS = ("знаю", "владею", "использую", "работаю с")
TAG_LABELS = ("skills?", "навыки")
YEAR_WORDS = ("год", "года", "лет")
YES_WORD = "да"
PATH_SEPARATOR = " в "

QUESTION_BLOCKS = {
    "context": (
        "Привет! Расскажи, пожалуйста, какая у тебя сейчас должность и в какой сфере ты работаешь?",
        "Сколько лет у тебя общего опыта работы?",
    ),
    "education": (
        "Какое у тебя образование? Расскажи про вуз, специальность или курсы.",
        "Какие языки программирования, инструменты или технологии ты чаще всего используешь?",
    ),
    "goals": (
        "Кем ты себя видишь через 1–3 года? Какая должность для тебя была бы следующей целью?",
        "Какой формат работы тебе ближе - офис, удалёнка или гибрид?",
        "Какой уровень дохода для тебя комфортный и мотивирующий?",
        "Что для тебя самое важное при выборе новой работы: стабильность, рост, интересные задачи, "
        "свобода, что-то ещё?",
    ),
}
FINAL_BLOCK = "recommendation"
TRANSITIONS = {
    "education": "Отлично! Теперь расскажи про образование и навыки. ",
    "goals": "Понятно! Давай теперь поговорим о твоих карьерных целях. ",
}
RETRY = "Пожалуйста, ответь более подробно на вопрос: "
GOALS = "Сейчас я работаю: {now}, через 1-3 года я бы хотел быть: {goal}"
NOTHING_FOUND = (
    "К сожалению, не удалось найти подходящие рекомендации. "
    "Попробуйте уточнить ваши карьерные цели."
)

VALIDATION_PROMPT = """Ты - помощник карьерного коуча. Твоя задача - проверить, ответил ли пользователь на заданный вопрос.

ВОПРОС: {question}
ОТВЕТ ПОЛЬЗОВАТЕЛЯ: {answer}

Критерии хорошего ответа:
- Краткий и ясный ответ
- Ответ может быть кратким в пару слов, это нормально
- Если ты предлагаешь конкретные варианты ответа, пользователь должен выбрать только среди них
- Длина ответа больше 5 символов

Ответь ТОЛЬКО "Да" или "Нет" без дополнительных пояснений."""

FINAL_SYSTEM_PROMPT = """Ты — опытный карьерный коуч, специализирующийся на технических ролях. Твоя задача — проанализировать КОНКРЕТНЫЕ найденные вакансии и дать подробные персональные рекомендации.

ОБЯЗАТЕЛЬНЫЕ ПРАВИЛА:
1. Используй ТОЛЬКО вакансии из списка 'found_positions' — не придумывай новые.
2. Упоминай конкретные компании и позиции по названиям.
3. Используй навыки из 'skills_to_develop' для плана развития.
4. Рассматривай карьерные пути из 'career_paths'.
5. Отвечай СТРОГО в формате JSON без лишнего текста.

ФОРМАТ ОТВЕТА:
{
  "response": "Текстовый анализ и рекомендации",
  "recommendation": {
    "nearest_position": "Должность в компании",
    "nearest_position_reason": "Причина выбора",
    "recommended_position": "Должность для следующего шага",
    "recommended_position_reason": "Причина выбора",
    "skills_gap": "Навыки для развития",
    "plan_1_2_years": "План развития на 1-2 года",
    "recommended_courses": ["Курс 1", "Курс 2"],
    "current_vacancies": ["Вакансия 1", "Вакансия 2"]
  }
}"""

FINAL_USER_PROMPT = """
АНАЛИЗИРУЙ СЛЕДУЮЩИЕ ДАННЫЕ И ДАЙ РЕКОМЕНДАЦИИ:

=== МОЙ ПРОФИЛЬ ===
{profile}

=== МОИ КАРЬЕРНЫЕ ЦЕЛИ ===
{goals}

=== НАЙДЕННЫЕ ДЛЯ МЕНЯ ВАКАНСИИ ===
{positions}

=== НАВЫКИ ДЛЯ РАЗВИТИЯ ===
{tags}

=== ВОЗМОЖНЫЕ КАРЬЕРНЫЕ ПУТИ ===
{paths}
"""

ADVICE_HEADER = "🔎 Рекомендации по карьерным шагам:\n"
ADVICE_NEAREST = "📍 **Ближайшая позиция:** "
ADVICE_NEXT = "⭐ **Рекомендуемая следующая позиция:** "
ADVICE_REASON = "Причина: "
ADVICE_GAP = "🛠 **Навыки для развития:** "
ADVICE_PLAN = "📅 **План развития на 1–2 года:**\n"
ADVICE_COURSES = "📚 **Рекомендованные курсы:**\n"
ADVICE_OPENINGS = "💼 **Актуальные вакансии:**\n"
ADVICE_BULLET = "   • "
