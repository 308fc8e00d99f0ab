"""What the SQL of the queries holds results against: the catalogue's rules stated once more, apart from the tables that the code reads."""

# ---- Fixed values: these decide results. ----
PLACEHOLDERS = """('-- unbranded --', '-- no unilog brand --', '-- no dib brand --', '-- no e1 brand --', 'n/a', 'none', '')"""
#: Spelling, approved unit.
UNITS = """(VALUES ('in', 'in'), ('in.', 'in'), ('inch', 'in'), ('inches', 'in'), ('"', 'in'), ('ft', 'ft'), ('ft.', 'ft'), ('foot', 'ft'), ('feet', 'ft'), ('mm', 'mm'), ('millimeter', 'mm'), ('millimeters', 'mm'),
  ('millimetre', 'mm'), ('millimetres', 'mm'), ('cm', 'cm'), ('centimeter', 'cm'), ('centimeters', 'cm'), ('centimetre', 'cm'), ('centimetres', 'cm'), ('m', 'm'), ('meter', 'm'), ('meters', 'm'),
  ('metre', 'm'), ('metres', 'm'), ('lb', 'lb'), ('lbs', 'lb'), ('lb.', 'lb'), ('lbs.', 'lb'), ('pound', 'lb'), ('pounds', 'lb'), ('kg', 'kg'), ('kilogram', 'kg'), ('kilograms', 'kg'), ('oz', 'oz'),
  ('oz.', 'oz'), ('ounce', 'oz'), ('ounces', 'oz'), ('g', 'g'), ('gram', 'g'), ('grams', 'g'), ('v', 'V'), ('volt', 'V'), ('volts', 'V'), ('a', 'A'), ('amp', 'A'), ('amps', 'A'), ('ampere', 'A'),
  ('amperes', 'A'), ('w', 'W'), ('watt', 'W'), ('watts', 'W'), ('kw', 'kW'), ('kilowatt', 'kW'), ('kilowatts', 'kW'), ('kw-hr', 'kW-hr'), ('kwh', 'kW-hr'), ('kw·h', 'kW-hr'), ('dba', 'dBA'),
  ('db(a)', 'dBA'), ('db', 'dB'), ('decibel', 'dB'), ('decibels', 'dB'), ('%', '%'), ('percent', '%'), ('pct', '%'), ('pct.', '%'), ('psi', 'psi'), ('p.s.i.', 'psi'), ('p.s.i', 'psi'), ('°f', '°F'),
  ('f', '°F'), ('deg f', '°F'), ('degrees f', '°F'), ('°c', '°C'), ('c', '°C'), ('deg c', '°C'), ('degrees c', '°C'), ('rpm', 'RPM'), ('r.p.m.', 'RPM'), ('cfm', 'CFM'), ('gpm', 'GPM'), ('hp', 'HP'),
  ('horsepower', 'HP'), ('btuh', 'BTUH'), ('btu/h', 'BTUH'), ('btu', 'BTU'), ('hr', 'hr'), ('hrs', 'hr'), ('hour', 'hr'), ('hours', 'hr'), ('min', 'min'), ('minute', 'min'), ('minutes', 'min'),
  ('pc', 'pc'), ('pcs', 'pc'), ('piece', 'pc'), ('pieces', 'pc'), ('ea', 'ea'), ('each', 'ea'), ('pk', 'pk'), ('pack', 'pk'), ('pr', 'pr'), ('pair', 'pr'), ('set', 'set')) AS u(spelling, uom)"""
#: Spelling, canonical value.
VALUES = """(VALUES ('stainless steel', 'Stainless Steel'), ('ss', 'Stainless Steel'), ('sst', 'Stainless Steel'), ('stainless-steel', 'Stainless Steel'), ('stainless', 'Stainless Steel'),
  ('stainless steel color', 'Stainless Steel'), ('steel', 'Steel'), ('aluminum', 'Aluminum'), ('aluminium', 'Aluminum'), ('alum', 'Aluminum'), ('plastic', 'Plastic'),
  ('polypropylene', 'Polypropylene'), ('pp', 'Polypropylene'), ('abs', 'ABS Plastic'), ('abs plastic', 'ABS Plastic'), ('copper', 'Copper'), ('brass', 'Brass'), ('cast iron', 'Cast Iron'),
  ('iron', 'Cast Iron'), ('glass', 'Glass'), ('tempered glass', 'Tempered Glass'), ('rubber', 'Rubber'), ('silicone', 'Silicone'), ('nylon', 'Nylon'), ('black', 'Black'), ('white', 'White'),
  ('silver', 'Silver'), ('gray', 'Gray'), ('grey', 'Gray'), ('red', 'Red'), ('blue', 'Blue'), ('green', 'Green'), ('bronze', 'Bronze'), ('nickel', 'Nickel'), ('chrome', 'Chrome'),
  ('brushed nickel', 'Brushed Nickel'), ('leg', 'Leg'), ('leg mounting', 'Leg'), ('built-in', 'Built-in'), ('built in', 'Built-in'), ('surface', 'Surface'), ('recessed', 'Recessed'),
  ('flush', 'Flush'), ('semi-flush', 'Semi-Flush'), ('pendant', 'Pendant'), ('wall', 'Wall'), ('ceiling', 'Ceiling'), ('hardwire', 'Hardwire'), ('hard wire', 'Hardwire'), ('hardwired', 'Hardwire'),
  ('cord', 'Cord'), ('nema 5-15', 'NEMA 5-15'), ('nema 5-20', 'NEMA 5-20'), ('dishwasher', 'Dishwasher'), ('yes', 'Yes'), ('true', 'Yes'), ('no', 'No'), ('false', 'No')) AS v(spelling, canonical)"""
CONTROLLED_LABELS = """('material', 'color', 'colour', 'finish', 'mounting type', 'plug type', 'product name', 'brand', 'brand name', 'series', 'type', 'style', 'fuel type', 'door style', 'handle style', 'control type',
  'installation type', 'item type', 'application')"""
#: All approved units but one.
KNOWN_UNITS = """('in', 'ft', 'mm', 'cm', 'm', 'lb', 'kg', 'oz', 'g', 'V', 'A', 'W', 'kW', 'kW-hr', 'dBA', 'dB', '%', 'psi', '°F', '°C', 'RPM', 'CFM', 'HP', 'BTUH', 'BTU', 'hr', 'min', 'pc', 'ea', 'pk', 'pr', 'set')"""
BLOCKED_SITES = """['amazon', 'ebay', 'walmart', 'grainger', 'mcmaster', 'fastenal', 'homedepot', 'lowes', 'menards', 'zoro', 'globalindustrial', 'uline', 'mscdirect', 'hdpe', 'plumbersstock', 'supplyhouse', 'ferguson',
  'build', 'acehardware', 'truevalue']"""
