"""Dimension tables, as plain values: units, factors, weights of pieces, densities, vulgar fractions, allowed characters."""

from __future__ import annotations

# Canonical unit -> class and spellings.
UNITS = {
    "tablespoon": ("volume", ("tbsp", "tbs", "tbsps", "tbsp.", "tablespoon", "tablespoons")),
    "teaspoon": ("volume", ("tsp", "tsps", "tsp.", "teaspoon", "teaspoons")),
    "milliliter": ("volume", ("ml", "milliliter", "milliliters", "millilitre", "millilitres")),
    "liter": ("volume", ("l", "liter", "liters", "litre", "litres")),
    "cup": ("volume", ("cup", "cups", "c")),
    "gram": ("weight", ("g", "gram", "grams")),
    "kilogram": ("weight", ("kg", "kilogram", "kilograms")),
    "ounce": ("weight", ("oz", "ounce", "ounces")),
    "pound": ("weight", ("lb", "lbs", "pound", "pounds")),
    "whole": ("piece", ("whole",)),
    "clove": ("piece", ("clove", "cloves")),
    "slice": ("piece", ("slice", "slices")),
    "block": ("piece", ("block", "blocks")),
    "can": ("piece", ("can", "cans")),
    "stick": ("piece", ("stick", "sticks")),
    "envelope": ("piece", ("envelope", "envelopes", "sheet", "sheets")),
    "bunch": ("piece", ("bunch", "bunches")),
    "head": ("piece", ("head", "heads")),
    "piece": ("piece", ("piece", "pieces", "pc", "pcs")),
    "inch": ("length", ("inch", "inches", '"')),
    "centimeter": ("length", ("cm", "centimeter", "centimeters", "centimetre", "centimetres")),
    "millimeter": ("length", ("mm", "millimeter", "millimeters", "millimetre", "millimetres")),
}
ALIASES = {alias: (unit, kind) for unit, (kind, aliases) in UNITS.items() for alias in aliases}
# Grams or millilitres of a unit.
FACTORS = {"gram": 1.0, "kilogram": 1000.0, "ounce": 28.349523125, "pound": 453.59237, "milliliter": 1.0, "liter": 1000.0, "tablespoon": 15.0, "teaspoon": 5.0, "cup": 240.0}
# Millimetres of a unit; lengths have no mass.
LENGTHS = {"millimeter": 1.0, "centimeter": 10.0, "inch": 25.4}
# Least and most grams of one piece, by pattern of its name, in order.
PIECES = [
    ("*egg*", 44.0, 63.0), ("*egg_yolk*", 15.0, 20.0), ("*egg_white*", 29.0, 38.0), ("*garlic*", 3.0, 8.0), ("*lemon*", 58.0, 120.0),
    ("*lime*", 44.0, 90.0), ("*onion*", 70.0, 400.0), ("*shallot*", 20.0, 50.0), ("*carrot*", 45.0, 90.0), ("*potato*", 90.0, 300.0),
    ("*banana*", 90.0, 145.0), ("*zucchini*", 120.0, 320.0), ("*eggplant*", 300.0, 550.0), ("*bell_pepper*", 90.0, 170.0),
    ("*capsicum*", 90.0, 170.0), ("*tomato*", 90.0, 250.0),
]
# Densities where no file gives them.
DENSITIES = [("powdered_sugar", 0.50), ("granulated_sugar", 0.85), ("all_purpose_flour", 0.52), ("water", 1.00), ("butter", 0.96), ("whole_milk", 1.03), ("olive_oil", 0.91)]
# Pieces whose weight depends on what is in them; a heaped spoon beside a level one.
OPAQUE = ("can", "block", "envelope", "bunch", "head", "stick", "piece", "slice")
HEAPED = (1.25, 1.75)
# Vulgar fractions.
VULGAR = {
    "¼": 1 / 4, "½": 1 / 2, "¾": 3 / 4, "⅐": 1 / 7, "⅑": 1 / 9, "⅒": 1 / 10, "⅓": 1 / 3, "⅔": 2 / 3, "⅕": 1 / 5,
    "⅖": 2 / 5, "⅗": 3 / 5, "⅘": 4 / 5, "⅙": 1 / 6, "⅚": 5 / 6, "⅛": 1 / 8, "⅜": 3 / 8, "⅝": 5 / 8, "⅞": 7 / 8,
}
# Words that hedge an amount, words after a number that make it a dimension, and foods measured by length.
HEDGES = ("about", "approximately", "approx", "roughly", "around", "nearly", "scant", "heaping", "heaped-up", "heaped", "generous", "rounded", "level", "full")
NOT_COUNTS = ("in", "m", "foot", "feet", "percent", "%", "degree", "degrees")
BY_LENGTH = (
    "ginger", "galangal", "turmeric", "horseradish", "wasabi", "lotus root", "burdock", "gobo", "daikon", "mooli", "lemongrass", "lemon grass",
    "leek", "rhubarb", "sugarcane", "sugar cane", "spring onion", "scallion", "green onion", "negi", "cucumber", "cinnamon", "cassia",
    "vanilla", "vanilla bean", "vanilla pod", "pandan", "kombu", "konbu", "kelp", "dashima", "baguette",
)
SHAPES = (
    "thick", "thickness", "thin", "deep", "depth", "wide", "width", "long", "length", "lengths", "tall", "high", "height", "square", "squares",
    "round", "rounds", "diameter", "across", "apart", "below", "above", "between", "from", "by", "x", "cube", "cubes", "chunk", "chunks",
    "strip", "strips", "ball", "balls", "log", "logs", "circle", "circles", "dice", "diced", "julienne", "matchstick", "matchsticks",
    "baton", "batons", "wedge", "wedges", "sliver", "slivers", "shred", "shreds",
)
# Nouns that only portion a length out, words that make an amount one of each piece, and words that begin a clause on how a linked
# thing is prepared.
PORTIONS = ("piece", "chunk", "knob", "length", "segment", "section", "stick", "nub", "thumb", "stub", "bit", "hunk")
PER_UNIT = ("each", "ea", "apiece", "per")
CLAUSES = (
    "using", "made", "prepared", "seasoned", "flavored", "flavoured", "thinned", "mixed", "blended", "folded", "topped", "with", "without", "plus",
)
# Characters beyond ASCII that texts may hold.
ALLOWED = "°–—½¼¾⅓⅔【】óéêèñöü⋮˙\u0323⋅"
# Metadata that tells a yield, words that begin one, words that may tell one elsewhere, what begins a line that tells none, and numbers as words.
YIELD_KEYS = ("yield", "yields", "serves", "servings", "portions", "pax")
YIELD_WORDS = ("yield", "yields", "serve", "serves", "makes", "portion", "portions", "pax", "serving", "servings")
LAX_YIELD_WORDS = (
    "yield", "yields", "serve", "serves", "serving", "servings", "make", "makes", "pax", "portion", "portions", "people", "quantity", "quantities",
    "qty", "piece", "pieces", "square", "squares", "slice", "slices", "loaves", "cookie", "cookies", "biscuit", "biscuits", "bun", "buns",
    "puff", "puffs", "muffin", "muffins",
)
NO_YIELDS = ("serve immediately", "serve with", "serve hot", "serve cold", "serve alongside", "serve over", "to serve", "toss to combine")
NUMBER_WORDS = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten")
# What a leading number measures if it is the size of something.
DIMENSIONS = (
    "inch", "inches", "in", "cm", "mm", "centimeter", "centimeters", "centimetre", "centimetres", "millimeter", "millimeters", "millimetre",
    "millimetres", "foot", "feet", "percent", "%",
)
# Findings and how severe they are.
SEVERITY = {
    "non-ascii-character": "warning", "yield-inferred": "info", "invalid-unit-class": "error", "invalid-nesting": "error", "conversion-discrepancy": "warning",
    "temperature-discrepancy": "warning", "component-without-directions": "warning", "no-section-headings": "warning", "missing-ingredients-section": "warning",
    "missing-directions-section": "warning", "section-inferred": "info", "quantity-unparsed": "error", "dimension-not-quantity": "info",
    "ingredient-name-empty": "warning", "implicit-count-unit": "info", "source-content-dropped": "warning",
}
