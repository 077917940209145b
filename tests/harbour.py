"""Boats in a harbour: documents with nested fields, arrays and missing fields."""

BOATS = [
    {"_id": 11, "name": "Alke", "crew": 4, "hull": {"length": 9.5, "unit": "m"}, "rig": "sloop", "gear": ["oar", "net"], "depths": [1.5, 4.0]},
    {"_id": 12, "name": "Birk", "crew": 12, "hull": {"length": 31.0, "unit": "ft"}, "rig": "ketch", "gear": ["net", "lamp", "oar"], "depths": [3.0]},
    {"_id": 13, "name": "Cato", "crew": 7, "hull": {"length": 40.0, "unit": "ft"}, "rig": "sloop", "gear": ["lamp"], "depths": [2.0, 9.0]},
    {"_id": 14, "name": "Dora", "crew": 30, "hull": {"length": 22.0, "unit": "m"}, "rig": "brig", "gear": [], "depths": [6.5], "stays": [{"port": "P1", "days": 3}, {"port": "P2", "days": 11}]},
    {"_id": 15, "name": "Edda", "crew": 1, "rig": "sloop", "gear": ["oar"], "stays": [{"port": "P2", "days": 2}]},
    {"_id": 16, "name": "Frey", "crew": 18, "hull": {"length": 15.0, "unit": "m"}, "rig": "brig", "gear": ["net", "oar"], "depths": [5.0, 5.5], "stays": [{"port": "P3", "days": 20}, {"port": "P1", "days": 1}]},
    {"_id": 17, "name": "raft", "tours": [{"title": "north", "legs": [{"to": "P4", "days": 6}, {"to": "P1", "days": 2}]}]},
    {"_id": 18, "name": "pram", "tours": [{"title": "south", "legs": [{"to": "P5", "days": 3}]}, {"title": "back", "legs": []}]},
]
