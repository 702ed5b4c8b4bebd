"""The facts and the questions with the answers that reasoning over facts alone must give."""

# (subject, predicate, object, time), in their order.
FACTS = [
    ('Jupiter', 'moon_count', 95, '2023-02'), ('Jupiter', 'moon_count', 95, '2023-03'), ('Saturn', 'moon_count', 83, '2023-02'),
    ('Saturn', 'moon_count', 83, '2023-03'), ('Saturn', 'moon_count', 83, '2022-11'), ('Earth', 'mass', 5.972e+24, None),
    ('Neptune', 'discovered_on', '1846-09-23', None), ('Astraea', 'discovered_on', '1845-12-08', None),
    ('Uranus', 'discovered_on', '1781-03-13', None), ('Jupiter', 'moon_count', '97', '2026-01-10'), ('Uranus', 'moon_count', 29, '2026-01-10'),
    ('Mercury', 'moon_count', 0, '2026-01-10'), ('Venus', 'moon_count', 0, '2026-01-10'), ('Earth', 'moon_count', 1, '2026-01-10'),
    ('Mars', 'moon_count', 2, '2026-01-10'), ('Saturn', 'moon_count', 274, '2026-01-10'), ('Neptune', 'moon_count', 16, '2026-01-10'),
    ('Pluto', 'classification', 'planet', '2004-12'), ('Venus', 'distance_from_sun', 108000000, None),
    ('Neptune', 'latest_known_moon', 'Hippocamp', '2022-08'), ('Mercury', 'moon_count', 0, '2022-08'), ('Venus', 'moon_count', 0, '2022-08'),
    ('Earth', 'moon_count', 1, '2022-08'), ('Mars', 'moon_count', 2, '2022-08'), ('Jupiter', 'moon_count', 80, '2022-08'),
    ('Saturn', 'moon_count', 83, '2022-08'), ('Uranus', 'moon_count', 27, '2022-08'), ('Neptune', 'moon_count', 14, '2022-08'),
    ('Uranus', 'moon_count', 27, '2022-04'), ('Pluto', 'is_planet', False, '2006-09'), ('Pluto', 'moon_count', 5, '2022-09'),
    ('Pluto', 'is_largest_dwarf_planet_by_size', True, '2022-12'), ('Pluto', 'is_planet', True, '2005-08'), ('Pluto', 'is_planet', True, '2006-07'),
    ('Neptune', 'discovered_by', 'Johann Galle', '1846'), ('Pluto', 'discovered_by', 'Clyde Tombaugh', '1930'),
    ('Ceres', 'classified_as_planet_at_discovery', True, None), ('Planet Nine', 'officially_discovered', False, '2022-12'),
    ('Pluto', 'classification', 'dwarf planet', '2022-12'), ('Pluto', 'location', 'Kuiper Belt', None), ('Pluto', 'moon_count', 5, '2022'),
    ('Makemake', 'classification', 'dwarf planet', '2022'), ('Makemake', 'location', 'Kuiper Belt', None), ('Makemake', 'moon_count', 1, '2022'),
    ('Eris', 'classification', 'dwarf planet', '2022'), ('Eris', 'location', 'Kuiper Belt', None), ('Eris', 'moon_count', 1, '2022'),
    ('Haumea', 'classification', 'dwarf planet', '2022'), ('Haumea', 'location', 'Kuiper Belt', None), ('Haumea', 'moon_count', 2, '2022'),
    ('Ceres', 'classification', 'dwarf planet', '2022'), ('Ceres', 'location', 'Asteroid Belt', None), ('Ceres', 'moon_count', 0, '2022'),
    ('Pluto', 'discovered_on', '1930-02-18', None), ('Haumea', 'discovered_on', '2004-12-28', None),
    ('Makemake', 'discovered_on', '2005-03-31', None), ('Ceres', 'discovered_on', '1801-01-01', None), ('Eris', 'discovered_on', '2005-01-05', None),
    ('Planet Nine', 'same_as_Lowell_Planet_X', False, None), ('Planet X', 'confirmed_beyond_Neptune', False, None),
    ('Planet Nine', 'discovery_status', 'not discovered', '2022-12'), ('Jupiter', 'mass', 1.898e+27, None), ('Neptune', 'mass', 1.024e+26, None),
    ('Uranus', 'mass', 8.681e+25, None), ('Mercury', 'mass', 3.30103e+23, None), ('Venus', 'mass', 4.86731e+24, None),
    ('Earth', 'mass', 5.97217e+24, None), ('Mars', 'mass', 6.41691e+23, None), ('Saturn', 'mass', 5.68317e+26, None),
    ('Earth', 'surface_gravity', 9.807, None), ('Mars', 'surface_gravity', 3.721, None), ('Mercury', 'surface_gravity', 3.7, None),
    ('Venus', 'surface_gravity', 8.87, None), ('Jupiter', 'surface_gravity', 24.79, None), ('Saturn', 'surface_gravity', 10.44, None),
    ('Uranus', 'surface_gravity', 8.69, None), ('Neptune', 'surface_gravity', 11.15, None), ('Mercury', 'distance_from_sun', 57900000.0, None),
    ('Earth', 'distance_from_sun', 149600000.0, None), ('Mars', 'distance_from_sun', 227900000.0, None),
    ('Jupiter', 'distance_from_sun', 778500000.0, None), ('Saturn', 'distance_from_sun', 1433000000.0, None),
    ('Uranus', 'distance_from_sun', 2872000000.0, None), ('Neptune', 'distance_from_sun', 4495000000.0, None),
    ('Mercury', 'moon_count', 0, '2023-12'), ('Venus', 'moon_count', 0, '2023-12'), ('Earth', 'moon_count', 1, '2023-12'),
    ('Mars', 'moon_count', 2, '2023-12'), ('Jupiter', 'moon_count', 95, '2023-12'), ('Saturn', 'moon_count', 145, '2023-12'),
    ('Uranus', 'moon_count', 28, '2023-12'), ('Neptune', 'moon_count', 16, '2023-12'), ('Jupiter', 'planet_type', 'gas giant', None),
    ('Saturn', 'planet_type', 'gas giant', None), ('Mercury', 'planet_type', 'terrestrial', None), ('Venus', 'planet_type', 'terrestrial', None),
    ('Earth', 'planet_type', 'terrestrial', None), ('Mars', 'planet_type', 'terrestrial', None), ('Uranus', 'planet_type', 'ice giant', None),
    ('Neptune', 'planet_type', 'ice giant', None), ('Ceres', 'classification', 'dwarf planet', '2022'),
    ('Solar System', 'planet_count', 8, '2022-12'), ('Blue moon', 'planet_with', None, None),
    ('Planetary rings', 'composition', '100% ice crystals', None), ('Eris', 'moon_count', 1, '2022-12'), ('Jupiter', 'moon_count', 6, '1904-12'),
    ('Jupiter', 'moon_count', 7, '1905-01'), ('Jupiter', 'moon_count', 12, '1974-08'), ('Jupiter', 'moon_count', 13, '1974-09'),
    ('Jupiter', 'moon_count', 69, '2018-06'), ('Jupiter', 'moon_count', 79, '2018-07'), ('Jupiter', 'moon_count', 79, '2021-10'),
    ('Jupiter', 'moon_count', 80, '2021-11'), ('Jupiter', 'moon_count', 80, '2022-02'), ('Jupiter', 'moon_count', 80, '2022-11'),
    ('Jupiter', 'moon_count', 95, '2025-06'), ('Jupiter', 'moon_count', 95, '2025-07'), ('Uranus', 'moon_count', 5, '1985-11'),
    ('Uranus', 'moon_count', 6, '1985-12'), ('Uranus', 'moon_count', 15, '1986-01'), ('Uranus', 'moon_count', 27, '2024-01'),
    ('Uranus', 'moon_count', 28, '2025-01'), ('Uranus', 'moon_count', 28, '2025-02'), ('Uranus', 'moon_count', 29, '2025-08'),
    ('Neptune', 'moon_count', 3, '1981-12'), ('Neptune', 'moon_count', 4, '1989-07'), ('Neptune', 'moon_count', 8, '1989-08'),
    ('Neptune', 'moon_count', 8, '2002-08'), ('Neptune', 'moon_count', 11, '2003-01'), ('Neptune', 'moon_count', 12, '2003-08'),
    ('Neptune', 'moon_count', 13, '2003-09'), ('Neptune', 'moon_count', 16, '2024-02'), ('Saturn', 'moon_count', 10, '1979-12'),
    ('Saturn', 'moon_count', 15, '1980-12'), ('Saturn', 'moon_count', 17, '1981-12'), ('Saturn', 'moon_count', 18, '1990-10'),
    ('Saturn', 'moon_count', 62, '2019-09'), ('Saturn', 'moon_count', 82, '2019-10'), ('Saturn', 'moon_count', 83, '2021-11'),
    ('Saturn', 'moon_count', 146, '2023-05'), ('Saturn', 'moon_count', 274, '2025-03'),
]

# (id, question, kind, value)
QUESTIONS = [
    (1, 'As of November 2022, how many confirmed moons orbit Jupiter?', 'single_number', 80),
    (2, 'As of June 2025, how many officially confirmed moons does Jupiter have?', 'single_number', 95),
    (3, 'In what year was Neptune discovered, and who discovered it?', 'multi_field', [('year', 'year', 1846), ('discoverer', 'entity', 'Johann Gottfried Galle')]),
    (4, 'As of February 2025, what is the total number of confirmed moons of Uranus?', 'single_number', 28),
    (5, 'Before 1980, how many of Saturn’s moons had been officially confirmed?', 'single_number', 10),
    (6, 'As of May 2023, what was the number of confirmed moons orbiting Saturn?', 'single_number', 146),
    (7, 'By April 2022, how many confirmed moons did Uranus have?', 'single_number', 27),
    (8, 'As of 2022, did the IAU recognize Pluto as the dwarf planet with the largest diameter?', 'boolean', True),
    (9, 'Which dwarf planet located in the Kuiper Belt was discovered first?', 'entity', 'Pluto'),
    (10, 'Between Neptune and Uranus, which planet has the greater mass?', 'entity', 'Neptune'),
    (11, 'Which planets orbit beyond Earth yet have fewer moons than Jupiter?', 'entity_list', ['Mars', 'Uranus', 'Neptune']),
    (12, 'List the terrestrial planets in order of decreasing mass.', 'ordered_list', ['Earth', 'Venus', 'Mars', 'Mercury']),
    (13, 'What is the total number of known moons orbiting Pluto?', 'single_number', 5),
    (14, 'Between Saturn and Uranus, which one is farther from the Sun?', 'entity', 'Uranus'),
    (15, 'As of November 2021, how many confirmed moons did Saturn have?', 'single_number', 83),
]
