"""Fixed values that results depend on: word lists, patterns, names and constants."""

# ruff: noqa: E501
# --- fixed values: categories ---
CATEGORIES = ("Reasoning", "Spatial Relation", "Affordance", "Counting", "Object Reference")
CATEGORIES_LOCAL = ("Affordance", "Object Reference", "Reasoning")
CATEGORIES_MERGED = (*CATEGORIES, "Steerable")
REMOVED_CATEGORY = "Spatial Relation"
CATEGORY_ALIAS = {
    "reasoning": "Reasoning",
    "spatial relation": "Spatial Relation",
    "spatial": "Spatial Relation",
    "affordance": "Affordance",
    "counting": "Counting",
    "object reference": "Object Reference",
    "objectref": "Object Reference",
    "reference": "Object Reference",
}
STEERABLE_ALIAS = {"steerable": "Steerable", "steerability": "Steerable"}
CATEGORY_EXPERT = {"affordance": "C", "counting": "C", "reasoning": "B", "spatial": "C", "steerability": "steer"}
EXPECTED_ACCURACY = {"affordance": 94.44, "counting": 70.41, "reasoning": 81.35, "spatial": 82.56, "steerability": 63.50}
REWRITE_KEYS = ("rewritten_query", "rewritten_instruction", "rewritten", "rewrite", "query", "rewritten_task", "text")
IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "webp", "bmp", "gif")

# --- fixed values: cues in queries ---
AFFORDANCE_CUES = (
    r"\bwhere you would\b",
    r"\bwhere (?:a person|someone|somebody|people) would\b",
    r"\bused to\b",
    r"\bused as\b",
    r"\bpeople use\b",
    r"\bperson uses\b",
    r"\buser uses\b",
    r"\bto (?:hold|grip|stabilize|drink|eat|sit|stand|open|close|press|push|pull|turn|type|write|read|cut|wash|carry|wear|hang|rest|lean)\b",
    r"\bfor (?:holding|gripping|stabilizing|drinking|eating|sitting|standing|opening|closing|pressing|pushing|pulling|turning|typing|writing|reading|cutting|washing|carrying|wearing|hanging|resting|leaning)\b",
    r"\b(?:item|object|tool|device|thing|part) that (?:tells time|joins paper together|can be lit|is used|can be used|is for|cuts|opens|closes|holds|stirs|mixes|calculates|measures|writes|reads)\b",
    r"\bdevices? with buttons\b",
    r"\bspace bar\b",
)
NON_HUMAN_CUES = (r"\bholding up\b", r"\bsupporting\b", r"\bcarrying people\b", r"\bresting upon\b", r"\bresting on\b")
EXISTING_POINT_CUES = (r"\bexisting point\b", r"\bcurrent point\b", r"\bexisting location\b", r"\bcurrent location\b", r"\bcursor\b")
SEMANTIC_CUES = (r"\bbook about\b", r"\bmarriage marker\b")
REASONING_CUES = (
    r"\bbook about\b", r"\bmarriage marker\b", r"\bdirection\b", r"\bmoving\b", r"\bmost likely\b", r"\bwhere people\b", r"\bmight\b", r"\bcontains?\b", r"\bat which\b",
    r"\bin the direction of\b", r"\briding\b", r"\bbackground\b", r"\bhorizon\b", r"\bempty space\b", r"\bspace between\b", r"\bspace to\b", r"\bholding up\b", r"\bsupporting\b", r"\bcarrying\b",
)
MULTI_INSTANCE_CUES = (r"\ball\b", r"\bseveral\b", r"\bmultiple\b", r"\beach\b", r"\bevery\b")

# --- fixed values: question styles ---
STYLE_ANCHOR = r"(?i)\b(blue point|existing point|current point|previous point|designated point|the point|current location|existing location|current position|previous location|previous points?|location in the existing image)\b"
STYLE_MOVE = (
    r"(?i)\b(moving|move the point|move the current point|move point|slightly move|move upward|move down|move left|move right|"
    r"(?:up|down|left|right|upward|downward|upwards|downwards)(?:\s+and\s+(?:left|right|up|down)|\s*,\s*then\s*(?:left|right|up|down|upward|upwards|downward|downwards)|"
    r"\s+then\s*(?:left|right|up|down|upward|upwards|downward|downwards))?\s+until)\b"
)
STYLE_NEAREST = r"(?i)\b(nearest|closest|closer)\b"
STYLE_TWO_STEP = r"(?i)\bthen\b|\band then\b"
STYLE_DIAGONAL = r"(?i)\b(up\s*(?:and|&)\s*(?:left|right)|down\s*(?:and|&)\s*(?:left|right)|up[- ]right|up[- ]left|down[- ]right|down[- ]left|upper[- ]right|upper[- ]left|lower[- ]right|lower[- ]left|diagonal|diagonally)\b"
STYLE_AXIS = (
    r"(?i)\b(to the right of|to the left of|right of|left of|above|below|under|beneath|at the top of|at the bottom of|on the left side|on the right side|directly below|directly above|"
    r"on the left of|on the right of|moving (?:slightly )?(?:left|right|up|down|upward|downward|upwards|downwards)|move (?:the point )?(?:left|right|up|down|upward|downward|upwards|downwards)|"
    r"move (?:a little |slightly )?to the (?:left|right)|moving (?:a little |slightly )?to the (?:left|right)|moving left|moving right|moving up|moving down|go (?:left|right|up|down))\b"
)
STYLE_SAME = (
    r"(?i)\b(where the blue point is|where the existing point is|where the blue point is located|currently directed|current point is on|existing point indicates|existing point refers|"
    r"existing point is directed|existing point directs|the one the existing point indicates|matches the one|base of the existing point|at the bottom of the existing point|at the top of the existing point)\b"
)

# --- fixed values: labels ---
STUFF_WORDS = (
    "background", "wall", "floor", "ceiling", "sky", "ground", "road", "street", "sidewalk", "grass", "water", "sand", "snow", "table", "desk",
    "counter", "shelf", "shelves", "cabinet", "door", "window", "mirror", "stairs", "step", "carpet", "rug", "plate", "bowl", "tray", "screen",
    "monitor", "paper", "papers", "sink", "backsplash", "cupboard", "cupboards", "stovetop", "countertop", "cabinetry", "tile", "tiles", "pavement",
    "concrete", "cement", "wood", "wooden",
)
SPATIAL_WORDS = (
    "corner", "edge", "top", "bottom", "left", "right", "middle", "center", "upper", "lower", "front", "back", "side", "line", "area", "space",
)
TEXTLIKE_WORDS = (
    "text", "word", "words", "letter", "letters", "number", "numbers", "writing", "logo", "logos", "watermark", "copyright", "caption", "title",
    "headline", "font", "fonts", "icon", "icons", "symbol", "symbols",
)
ARTIFACT_WORDS = (
    "reflection", "reflections", "glare", "shadow", "shadows", "highlight", "highlights", "shine", "blur", "blurry", "texture", "textured",
    "lighting",
)
REGION_WORDS = (
    "surface", "area", "section", "piece", "pieces", "part", "parts", "spot", "spots", "mark", "marks", "line", "lines", "point", "points", "tip",
    "tips", "base", "center", "middle", "rim", "edge", "edges",
)
RELATIONAL_WORDS = (
    "of", "on", "in", "with", "behind", "under", "inside", "outside", "between", "from", "near", "around", "across", "through",
)
FUNCTIONAL_WORDS = (
    "where", "used", "use", "would", "hold", "holds", "holding", "go", "goes", "open", "close", "drink", "read", "write", "sit", "stand",
)
BAD_HEAD_WORDS = (*TEXTLIKE_WORDS, *ARTIFACT_WORDS, *REGION_WORDS, "thing", "things", "object", "objects", "item", "items", "image", "photo", "picture", "scene")
ATTRIBUTE_WORDS = (
    "black", "white", "red", "green", "blue", "yellow", "brown", "orange", "pink", "purple", "gold", "silver", "gray", "grey", "sharp", "silky",
    "curious", "furry", "fur",
)
ABSTRACT_WORDS = (
    "food", "meal", "dinner", "supper", "lunch", "breakfast", "cuisine", "time", "brand", "drawing", "painting", "artwork", "bubble", "horizon",
    "light", "female",
)
GENERIC_LABELS = (
    "text", "words", "letters", "numbers", "logo", "background", "shadow", "shadows", "glare",
)
QUESTION_OPENERS = ("where ", "what ", "which ", "who ", "how ")

# --- fixed values: templates ---
TEMPLATE_REQUIRED = {
    "straight_axis_templates": ("{label}",),
    "single_diagonal_templates": ("{label}",),
    "two_step_axis_templates": ("{first_axis}", "{label}", "{second_axis}"),
    "nearest_among_objects_templates": ("{label}",),
}
TEMPLATE_DIRECTION = {
    "straight_axis_templates": ("{axis_direction}", "{axis_phrase}"),
    "single_diagonal_templates": ("{diagonal_direction}", "{diagonal_phrase}"),
}
TEMPLATE_BANNED = {
    "blue_point_as_mark": r"(?i)\b(starting mark|reference mark|blue reference mark|mark the|mark\b)\b",
    "ui_specific": r"(?i)\b(cursor|click|tap|hover|drag|slide)\b",
    "navigation_style": r"(?i)\b(navigate|proceed|target the|trace a path|follow the path)\b",
    "guide_wording": r"(?i)\bguide\b",
    "unnatural_modifier": r"(?i)\b(exactly|directly at|physically closest|residing|you can find)\b",
}
TEMPLATE_GROUP_BANNED = {
    "straight_axis_templates": {
        "diagonal_wording": r"(?i)\b(diagonal|diagonally|up-right|up-left|down-right|down-left)\b",
        "nearest_wording": r"(?i)\b(nearest|closest|nearby?)\b",
    },
    "single_diagonal_templates": {"two_step_wording": r"(?i)\bthen\b|\band then\b"},
    "two_step_axis_templates": {"collapsed_diagonal": r"(?i)\b(diagonal|diagonally|up-right|up-left|down-right|down-left)\b"},
    "nearest_among_objects_templates": {
        "missing_nearest_word": r"(?i)^(?!.*\b(nearest|closest)\b).*$",
        "vague_near": r"(?i)\b(near the blue point|nearby|around the blue point)\b",
    },
}

# --- fixed values: directions and tasks ---
DIRECTIONS = {"right": 0.0, "down-right": 45.0, "down": 90.0, "down-left": 135.0, "left": 180.0, "up-left": 225.0, "up": 270.0, "up-right": 315.0}
AXIS_DIRECTIONS = ("right", "down", "left", "up")
DIAGONAL_DIRECTIONS = ("up-right", "down-right", "down-left", "up-left")
TASK_TYPES = ("move_until_axis_fixed", "move_until_axis_from_other_object", "move_then_axis_limited_fixed", "nearest_among_objects", "nearest_among_objects_axis_constrained")
#: Tasks of a mix from scarce to plentiful, and their shares of it in hundredths of a per cent.
TASK_SHARES = {"move_until_axis_from_other_object": 250, "move_then_axis_limited_fixed": 250, "nearest_among_objects_axis_constrained": 500, "nearest_among_objects": 500, "move_until_axis_fixed": 8500}

# --- fixed values: coarse tasks by substrings, first list that matches wins ---
COARSE_TASKS = (
    ("free_space_reference", ("vacant", "free space", "empty space", "empty area")),
    ("spatial_relation", ("left", "right", "between", "behind", "in front", "closest", "farthest")),
    ("counting", ("how many", "count", "all ")),
    ("affordance", ("tool", "used for", "can be used", "afford")),
    ("reasoning", ("reason", "why", "best", "likely", "safest")),
    ("object_reference", ("point",)),
)

# --- fixed values: adapter targets by the last part of a module's name ---
MODULE_LEAVES = (
    "q_proj", "k_proj", "v_proj", "o_proj", "gate_proj", "up_proj", "down_proj", "wq", "wk", "wv", "wo", "w1", "w2", "w3", "att_proj", "attn_out",
    "ff_proj", "ff_out",
)
MODULE_SCOPES = {"vision+llm": ("vision", "projector", "llm"), "all": ("vision", "projector", "llm"), "llm_only": ("llm", "projector"), "vision_only": ("vision",)}
RECORD_SOURCES_NEED = ("id", "source", "task_type", "image_path", "query")
POINT_FORMATS = ("xy_abs_pixels", "xy_norm_01")
