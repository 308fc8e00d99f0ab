"""Lookup tables that catalogue rules use. Taxonomies, master lists and header layouts are data: parameters, not code."""

from __future__ import annotations

# ---- Fixed values: these decide results and are stated as they are used. ----
PLACEHOLDERS = ["-- unbranded --", "-- no unilog brand --", "-- no dib brand --", "-- no e1 brand --", "n/a", "none", ""]
BRAND_PLACEHOLDERS = [*PLACEHOLDERS, "unbranded"]
CATALOGUE_COLUMNS = ["Mfg_Part_Num", "Part_Desc", "E1_Brand", "Unilog_Brand", "DIB_Brand", "Part_Manuf"]
HEADER_ALIASES = {
    "Mfg_Part_Num": ["manufacturerpartnumber", "manufacturerpartnum", "mfrpartnumber", "mfgpartnumber", "mfgpartnum", "mfrpartnum", "manufpartnumber", "manufacturernumber", "itemnumber", "itemno", "itemnum", "productcode", "partcode", "modelno", "productnumber", "modelnumber", "cataloguenumber", "catnumber", "skunumber", "partnumber", "partno", "partnum", "partid", "mpn", "sku", "pn"],
    "Part_Desc": ["partdescription", "productdescription", "itemdescription", "productname", "itemname", "partdesc", "description", "producttitle", "itemtitle", "desc"],
    "E1_Brand": ["e1brand", "ebrand", "brand1", "brandone"],
    "Unilog_Brand": ["unilogbrand", "ubrand", "genericbrand", "brand"],
    "DIB_Brand": ["dibbrand", "dbrand", "brand2", "secondarybrand"],
    "Part_Manuf": ["partmanufacturer", "partmanufacture", "manufacturername", "manufacturermfr", "manufacturer", "partmanuf", "mfr", "mfg", "maker", "vendor", "supplier", "brandowner"],
}
#: Applied in this order, without regard to case: (what, expansion); a word stands between word borders, and a pressure class not after a digit.
ABBREVIATIONS = [
    ("CPLG", "Coupling"), ("ELB", "Elbow"), ("ELL", "Elbow"), ("RED", "Reducer"), ("NIP", "Nipple"), ("BUSH", "Bushing"), ("FLG", "Flange"), ("VLV", "Valve"),
    ("CHK", "Check Valve"), ("NDL", "Needle"), ("GLB", "Globe"), ("FTG", "Fitting"), ("ADPT", "Adapter"), ("SWAG", "Swage"), ("BRS", "Brass"), ("BRZ", "Bronze"),
    ("SST", "Stainless Steel"), ("CPVC", "CPVC"), ("ALUM", "Aluminum"), ("NYL", "Nylon"), ("TEFLON", "PTFE"), ("MNPT", "Male NPT"), ("FNPT", "Female NPT"),
    ("MIP", "Male Iron Pipe"), ("FIP", "Female Iron Pipe"), ("COMP", "Compression"), ("150#", "150 lb"), ("300#", "300 lb"), ("600#", "600 lb"), ("3000#", "3000 lb"),
    ("6000#", "6000 lb"), ("SCH 40", "Schedule 40"), ("SCH 80", "Schedule 80"), ("SCH 160", "Schedule 160"), ("HEX", "Hex"), ("STD", "Standard"), ("XHVY", "Extra Heavy"),
]
#: Approved unit: its spellings in lower case.
UNITS = {
    "in": ["in", "in.", "inch", "inches", '"'], "ft": ["ft", "ft.", "foot", "feet"], "mm": ["mm", "millimeter", "millimeters", "millimetre", "millimetres"],
    "cm": ["cm", "centimeter", "centimeters", "centimetre", "centimetres"], "m": ["m", "meter", "meters", "metre", "metres"], "lb": ["lb", "lbs", "lb.", "lbs.", "pound", "pounds"],
    "kg": ["kg", "kilogram", "kilograms"], "oz": ["oz", "oz.", "ounce", "ounces"], "g": ["g", "gram", "grams"], "V": ["v", "volt", "volts"], "A": ["a", "amp", "amps", "ampere", "amperes"],
    "W": ["w", "watt", "watts"], "kW": ["kw", "kilowatt", "kilowatts"], "kW-hr": ["kw-hr", "kwh", "kw·h"], "dBA": ["dba", "db(a)"], "dB": ["db", "decibel", "decibels"],
    "%": ["%", "percent", "pct", "pct."], "psi": ["psi", "p.s.i.", "p.s.i"], "°F": ["°f", "f", "deg f", "degrees f"], "°C": ["°c", "c", "deg c", "degrees c"], "RPM": ["rpm", "r.p.m."],
    "CFM": ["cfm"], "GPM": ["gpm"], "HP": ["hp", "horsepower"], "BTUH": ["btuh", "btu/h"], "BTU": ["btu"], "hr": ["hr", "hrs", "hour", "hours"], "min": ["min", "minute", "minutes"],
    "pc": ["pc", "pcs", "piece", "pieces"], "ea": ["ea", "each"], "pk": ["pk", "pack"], "pr": ["pr", "pair"], "set": ["set"],
}
#: Units that validation knows: one approved unit is not among them.
KNOWN_UNITS = [u for u in UNITS if u != "GPM"]
CONTROLLED_LABELS = ["material", "color", "colour", "finish", "mounting type", "plug type", "product name", "brand", "brand name", "series", "type", "style", "fuel type", "door style", "handle style", "control type", "installation type", "item type", "application"]
#: Canonical value: its spellings in lower case.
VALUES = {
    "Stainless Steel": ["stainless steel", "ss", "sst", "stainless-steel", "stainless", "stainless steel color"], "Steel": ["steel"], "Aluminum": ["aluminum", "aluminium", "alum"],
    "Plastic": ["plastic"], "Polypropylene": ["polypropylene", "pp"], "ABS Plastic": ["abs", "abs plastic"], "Copper": ["copper"], "Brass": ["brass"], "Cast Iron": ["cast iron", "iron"],
    "Glass": ["glass"], "Tempered Glass": ["tempered glass"], "Rubber": ["rubber"], "Silicone": ["silicone"], "Nylon": ["nylon"], "Black": ["black"], "White": ["white"], "Silver": ["silver"],
    "Gray": ["gray", "grey"], "Red": ["red"], "Blue": ["blue"], "Green": ["green"], "Bronze": ["bronze"], "Nickel": ["nickel"], "Chrome": ["chrome"], "Brushed Nickel": ["brushed nickel"],
    "Leg": ["leg", "leg mounting"], "Built-in": ["built-in", "built in"], "Surface": ["surface"], "Recessed": ["recessed"], "Flush": ["flush"], "Semi-Flush": ["semi-flush"], "Pendant": ["pendant"],
    "Wall": ["wall"], "Ceiling": ["ceiling"], "Hardwire": ["hardwire", "hard wire", "hardwired"], "Cord": ["cord"], "NEMA 5-15": ["nema 5-15"], "NEMA 5-20": ["nema 5-20"],
    "Dishwasher": ["dishwasher"], "Yes": ["yes", "true"], "No": ["no", "false"],
}
BLOCKED_SITES = ["amazon", "ebay", "walmart", "grainger", "mcmaster", "fastenal", "homedepot", "lowes", "menards", "zoro", "globalindustrial", "uline", "mscdirect", "hdpe", "plumbersstock", "supplyhouse", "ferguson", "build", "acehardware", "truevalue"]
DOCUMENT_TYPES = {"product_page": "Product Page", "specification_sheet": "Spec Sheet", "installation_manual": "Manual", "catalogue": "Catalogue", "technical_doc": "Tech Doc"}
IRREGULAR_SINGULARS = {
    "accessories": "accessory", "analyzers": "analyzer", "brushes": "brush", "cabinets": "cabinet", "clutches": "clutch", "couplers": "coupler", "disconnects": "disconnect", "filters": "filter", "fixtures": "fixture",
    "generators": "generator", "lamps": "lamp", "lashes": "latch", "meters": "meter", "pumps": "pump", "reducers": "reducer", "sensors": "sensor", "switches": "switch", "valves": "valve",
}
MATERIAL_SHORT = {"stainless steel": "SST", "stainless-steel": "SST", "brass": "BRS", "bronze": "BRZ", "aluminum": "ALUM", "aluminium": "ALUM", "nylon": "NYL", "copper": "CPR", "cast iron": "CI", "plastic": "PLS"}
#: Facts that become attributes, in this order, and their labels; what kind of product it is and its number are no attributes.
FACT_LABELS = {
    "material": "Material", "size": "Size", "finish": "Finish", "color": "Color", "shape": "Shape", "pressure_rating": "Pressure Rating", "temperature_rating": "Temperature Rating", "voltage": "Voltage", "amperage": "Amperage",
    "wattage": "Wattage", "thread_type": "Thread Type", "connection_type": "Connection Type", "end_type": "End Type", "gender": "Gender", "application": "Application", "industry": "Industry", "series": "Series",
}
#: All facts that a description may state under a name of their own.
FACTS = ["product_type", "series", "model_number", "size", "material", "finish", "color", "shape", "pressure_rating", "temperature_rating", "voltage", "amperage", "wattage", "thread_type", "connection_type", "end_type", "gender", "application", "industry"]
LENGTH_LIMITS = {"INVOICE_DESC": 40}
WEIGHTS = {"manufacturer": 0.25, "classification": 0.25, "lov": 0.20, "uom": 0.15, "grounding": 0.15}
HIGH_ABOVE, MEDIUM_FROM, LOW_CONFIDENCE, REVIEW_BELOW = 0.85, 0.60, 0.70, 0.70
BM25_K1, BM25_B = 1.5, 0.75
CHUNK_WORDS, CHUNK_STEP = 500, 450
DESCRIPTIONS = ["MOBILE_DESC", "INVOICE_DESC", "SHORT_DESC", "LONG_DESC1", "RETAIL_DESC", "MARKETING_DESCRIPTION"]
# ---- End of fixed values. ----


def inverted(table: dict[str, list[str]]) -> dict[str, str]:
    return {spelling: name for name, spellings in table.items() for spelling in spellings}


def delivery_columns() -> list[str]:
    """The wide layout: numbered columns by rule, the others by name; 252 in all."""
    numbered = lambda stem, n: [f"{stem}{i}" for i in range(1, n + 1)]
    measures = [c for m in ("LENGTH", "HEIGHT", "WIDTH", "WEIGHT", "VOLUME") for c in (m, f"{m}_UOM")]
    slots = [f"ATTRIBUTE_{part} {i}" for i in range(1, 51) for part in ("LABEL", "VALUE", "UOM")]
    return [
        "MFR URL", *numbered("Ref URL ", 5), "PART_NUMBER", "SKU - MY_PART_NUMBER", "Mfg_Part_Num", "MANUFACTURER_PART_NUMBER", "ALTERNATE_PART_NUMBER", *CATALOGUE_COLUMNS[1:], "Classpath", "Dept", "Class", "Fine",
        "Product Name", "MANUFACTURER_NAME", "BRAND_NAME", "TRADE_NAME", *DESCRIPTIONS, *numbered("ITEM_FEATURES_", 20), "With", "Standard/Approvals", "Prop 65", "Application", "Includes", *slots,
        "UPC", "EAN", "GTIN", "UNSPSC", "Warranty", "List Price", "Selling Qty", "Selling UOM", "Standard Packaging Information", *measures, "Product Image", "Specification Sheet", *numbered("Alternate Image ", 4),
        "SDS", "SDS_1", "Warranty Information", "Catalog", "Instruction/Installation Manual", "Service Manual", "Owners/User Manual", "Line Drawing", "MTR", "RoHS", "Full Engineering Drawing", "Energy Star Guide",
        "Technical Bulletin", "Submittal", "Compatibility Chart", "Size Chart", "Product Label/Insert", "Video Link", "Video Link 1", "Country Of Origin", "Discontinued", "Actual Image (Yes/No)",
    ]
