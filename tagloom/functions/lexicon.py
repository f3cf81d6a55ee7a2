"""Word lists and label tables.

Fixed values: the lists below are data that results depend on.  All can be
replaced by arguments of the functions that use them.
"""

#: Tokens that are dropped whole.
DROP_TOKENS = (
    "til", "extra", "chopped", "finely", "tablespoon", "tablespoons", "teaspoon", "teaspoons", "tbsp", "tsp", "spoon", "spoons", "to", "cut", "pinch", "ounce", "ounces", "pound", "pounds", "toasted", "whole", "all", "sauce", "piece",
    "water", "peeled", "water water", "salt", "for", "minced", "grated", "slices", "baking", "cup", "cups", "thinly", "sifted", "melted", "stick", "28-ounce", "couple", "1 (", "halved", "plus", "2inch piece", "seeded", "turns", "sugar",
    "wrappers ", "purpose", "degrees", "one", "two", "seedisclaimer", "note", "ingredient", "ingredient note", "network", "eyeball", "split", "legs", "thighs", "food", "inspirations", "hellman", "kitchen", "pods",
)
#: A token that holds one of these is dropped.
DROP_SUBSTRINGS = ("spoon", "baking", "ounce", "pound", "cup", "slice")
#: Words that are taken out of phrases.
PHRASE_NOISE = (
    "slice", "slices", "sliced", "chunk", "chunks", "chunky", "chunked", "piece", "pieces", "cup", "cups", "tablespoon", "tablespoons", "tbsp", "teaspoon", "teaspoons", "tsp", "lb", "lbs", "pound", "pounds", "oz", "ounce", "ounces",
    "gram", "grams", "kg", "ml", "l", "liter", "liters", "pinch", "powder", "powders", "powdered",
)
#: A phrase with one of these after its first word keeps its form.
STOP_SUFFIXES = ("powder", "sauce", "paste", "broth", "stock", "soup", "granules", "mix", "dressing", "rings", "juice", "puree")
#: Forms with one canonical name.
CANONICAL_SETS = {
    "onion": ("onion", "onions", "baby onions", "garden onions", "green onions", "salad onions"),
    "chicken": ("chicken", "chickens"),
}
#: Descriptive words and units that the rule-based normaliser takes out.
DESCRIPTIVE = (
    "fresh", "ripe", "frozen", "thawed", "organic", "unsalted", "salted", "sweetened", "unsweetened", "minced", "chopped", "diced", "sliced", "crushed", "ground", "grated", "shredded", "powdered", "large", "small", "medium", "extra",
    "virgin", "golden", "dark", "light", "skinless", "boneless",
)
UNITS = ("cup", "cups", "tbsp", "tablespoon", "tablespoons", "tsp", "teaspoon", "teaspoons", "g", "kg", "oz", "ounce", "ounces", "ml", "l", "lb", "lbs", "pound", "pounds")
#: Heads that say little alone: one modifier stays with them.
GENERIC_HEADS = ("powder", "sauce", "paste", "oil", "vinegar", "cheese")
#: Words that end the part of a phrase in which its head is.
FUNCTION_WORDS = ("in", "with", "for", "from", "or", "and", "to", "without", "as", "on", "at", "by", "such", "like", "plus")
#: Phrases too general to stand for others.
GENERIC = ("salt", "sea salt", "water", "oil", "sugar", "pepper")
#: Words that don't count as an overlap of phrases.
OVERLAP_STOPS = ("salt", "water", "oil", "sugar", "pepper", "flour", "butter", "garlic", "onion")
#: Preparation words that the recommender's cleaner drops.
PREPARATION = ("finely", "follows", "diced", "cut", "for", "chopped", "sliced", "pieces")
#: Labels that say nothing.
GENERIC_LABELS = ("kid friendly", "friendly")
#: Spellings and regions with their label.
LABEL_CORRECTIONS = {
    "mediteranean": "Mediterranean", "mediterranean": "Mediterranean", "middle": "Middle Eastern", "middle eastern": "Middle Eastern", "east-asian": "East Asian", "east asian": "East Asian", "cajun & creole": "Cajun", "cajun and creole": "Cajun",
    "karnataka": "Indian", "kerala": "Indian", "tamil nadu": "Indian", "maharashtrian": "Indian", "maharashtra": "Indian", "gujarati": "Indian", "goan": "Indian", "jharkhand": "Indian",
}
#: Parents with a common name.
PARENT_ALIASES = {"oriental": "Asian", "east asian": "Asian", "asian": "Asian", "indian": "Indian", "mediterranean": "Continental", "european": "Continental"}
#: Column names under which records and labels are looked for, in this order.
RECORD_COLUMNS = ("ingredients", "ingredient", "ing", "ingr", "ingredient_list", "ingredients_list")
LABEL_COLUMNS = ("cuisine", "cuisines", "country", "countries", "type", "category", "region")
#: Texts that mean a missing value.
MISSING = ("", "nan", "none", "null", "[]")
