"""Fixed vocabularies. All of them are fixed values that results depend on."""

# Predicates, in order.
PREDICATES = [
    "name", "age", "occupation", "employer", "job_title", "lives_in", "hometown", "birthday", "family_relation", "pet", "health_condition",
    "education", "skill", "language", "likes", "dislikes", "prefers", "allergic_to", "dietary_restriction", "goal", "plan", "budget", "owns", "uses",
    "subscribes_to", "quantity", "purchased", "visited", "attended", "scheduled", "started", "stopped", "completed", "experienced", "email", "phone",
    "address", "social_account", "other",
]
# Predicates that hold one value, and one that counts things.
FUNCTIONAL = [
    "name", "age", "occupation", "employer", "job_title", "lives_in", "hometown", "birthday", "email", "phone", "address", "budget",
]
COUNTED = ["quantity"]
# Fixed value: a count at the start of a value (lower case).
LEADING_COUNT = r"^\s*(?:\d[\d,.]*|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve)\s+(?:of\s+)?"
# Entity types, and those of object values by predicate.
ENTITY_TYPES = [
    "person", "org", "place", "thing", "preference", "event",
]
OBJECT_TYPES = {"employer": "org", "subscribes_to": "org", "lives_in": "place", "hometown": "place", "address": "place", "family_relation": "person", "attended": "event", "scheduled": "event"}
# Values that say that there is none.
EMPTY_VALUES = ["none", "nothing", "unknown", "n/a", "na", "null", "unspecified", "not applicable"]
EMPTY_PREFIXES = ["none ", "nothing ", "not mentioned", "no specific", "not specified"]
# Words for the two speakers, and their keys.
SELF_FORMS = ["user", "i", "me", "myself", "the user", "my"]
ASSISTANT_FORMS = ["assistant", "you", "the assistant", "ai", "bot", "chatbot", "the ai"]
SELF_KEY, ASSISTANT_KEY = "person:user", "person:assistant"
# Words of a question that are no names.
SELF_CUES = ["i", "me", "my", "mine", "myself", "i'm", "im", "i've", "ive", "i'd", "i'll"]
SECOND_PERSON = ["you", "your", "yours", "yourself", "you've", "youve", "you'd", "you'll", "you're", "youre"]
STARTERS = [
    "what", "when", "where", "who", "why", "how", "which", "did", "do", "does", "is", "was", "are", "were", "has", "have", "had", "can", "could",
    "should", "would", "will", "the", "a", "an", "my", "i", "in", "on", "at", "if", "tell", "any", "some", "please", "let", "also", "just", "given",
    "based", "recently", "lately", "there", "these", "those", "after", "before", "since", "during", "while", "hey", "thanks", "recommend", "suggest",
]
# Months by number, and other calendar words.
MONTHS = {"jan": 1, "january": 1, "feb": 2, "february": 2, "mar": 3, "march": 3, "apr": 4, "april": 4, "may": 5, "jun": 6, "june": 6, "jul": 7, "july": 7, "aug": 8, "august": 8, "sep": 9, "sept": 9, "september": 9, "oct": 10, "october": 10, "nov": 11, "november": 11, "dec": 12, "december": 12}
CALENDAR = [*MONTHS, *"monday tuesday wednesday thursday friday saturday sunday today tomorrow yesterday christmas easter thanksgiving".split()]
# Words inside a predicate's name that say nothing.
NAME_GLUE = ["to", "in", "of", "at", "on", "for", "is", "by"]
# Phrases by which a question asks for a predicate.
CUES = {
    "employer": ["work", "work for", "work at", "employer", "company", "employed"],
    "job_title": ["job title", "my title", "my role", "my position"],
    "occupation": ["for a living", "occupation", "profession", "career", "my job"],
    "lives_in": ["live", "living", "moved to", "residence", "reside", "what city"],
    "hometown": ["grew up", "come from", "originally from", "born in"],
    "family_relation": ["sister", "brother", "mother", "father", "wife", "husband", "son", "daughter", "cousin", "parents"],
    "health_condition": ["diagnosed", "condition", "symptom", "illness", "injury"],
    "dietary_restriction": ["vegan", "vegetarian", "gluten", "diet"],
    "allergic_to": ["allergy", "allergies", "allergic"],
    "likes": ["favourite", "favorite", "enjoy", "into", "fan of"],
    "dislikes": ["hate", "dislike", "can't stand", "avoid"],
    "prefers": ["prefer", "preference", "rather"],
    "purchased": ["buy", "bought", "purchase", "ordered", "paid for"],
    "visited": ["visit", "went to", "travelled", "traveled", "trip to"],
    "attended": ["attend", "went to the", "conference", "concert", "wedding"],
    "scheduled": ["scheduled", "appointment", "booked", "upcoming"],
    "started": ["start", "started", "began", "took up"],
    "stopped": ["stop", "stopped", "quit", "gave up"],
    "completed": ["finish", "finished", "completed", "graduated"],
    "goal": ["goal", "aiming", "want to", "trying to"],
    "plan": ["plan", "planning", "going to"],
    "budget": ["budget", "spend", "afford", "how much"],
    "owns": ["own", "have a", "my car", "my house"],
    "quantity": ["how many", "how much", "number of", "count", "how long"],
    "uses": ["use", "using", "app", "tool"],
    "subscribes_to": ["subscribe", "subscription", "member of"],
    "education": ["study", "studied", "degree", "university", "school", "course"],
    "skill": ["skill", "good at", "learning", "practice"],
    "language": ["language", "speak", "fluent"],
    "pet": ["pet", "dog", "cat"],
    "age": ["how old", "age", "birthday"],
    "name": ["my name", "called"],
    "email": ["email", "e-mail"],
    "phone": ["phone", "number"],
    "address": ["address", "street", "postcode", "zip"],
}
# Reasons to abstain, in order of the cascade.
REASONS = [
    "unknown_entity", "no_such_relation", "no_fact_in_window", "no_path", "not_in_graph", "uncited_answer", "fabricated_citation", "empty_graph",
]
# Bounds.
MAX_SPAN, NARROW_CAP, TOP_K, MAX_LEN, PATH_LIMIT, PER_TYPE = 240, 60, 10, 4, 64, 20
NO_GATES = "(no gates)"
# Arms that have no gates.
UNGATED_ARMS = ["full_context", "vector_rag"]
DAY = 86400


def cue_pattern(predicate: str) -> str:
    """A pattern, over lower-cased text, that any phrase or any telling part of the name of a predicate matches."""
    parts = [p for p in predicate.split("_") if p not in NAME_GLUE]
    # Parts of the name are compared with words of letters, digits and apostrophes, phrases at word bounds.
    words = "|".join(parts)
    pattern = rf"(?:^|[^a-z0-9'])(?:{words})(?:$|[^a-z0-9'])"
    if predicate in CUES:
        pattern += rf"|\b(?:{'|'.join(c.replace('.', chr(92) + '.') for c in CUES[predicate])})\b"
    return pattern
