"""Small literal corpora with known answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as T

FILES = "repo string, path string, content string"


def files_frame(spark, rows):
    df = spark.createDataFrame([(r, p, c) for r, p, c in rows], FILES)
    return df.withColumn("n_lines", T.line_count(F.col("content")))


def section(name, refs, body="text"):
    lines = [f"<!-- docs:start:{name} -->", f"## {name.title()}", body]
    lines += [f"<!-- docs:refs:{r} -->" for r in refs]
    return "\n".join([*lines, f"<!-- docs:end:{name} -->", ""])


# Berth bookings of a harbour: six routes in three files, one of them guarded as a whole.
PACKAGE = """{
  "name": "harbour-desk", "version": "0.3.0", "description": "Berth bookings", "main": "src/server.js",
  "dependencies": {"fastify": "^4.26.0"},
  "devDependencies": {"vitest": "^1.3.0"}
}
"""
SERVER = """import fastify from 'fastify';
import { berths } from './berths/handlers.js';
import tides from './tides.js';

const desk = fastify();
desk.get('/ping', async () => 'up');
desk.register(berths);
desk.register(tides);
export const port = Number(process.env.DESK_PORT);
"""
BERTHS = """import { requireAuth } from '../guards/badge.js';
const known = new Map();
export async function berths(desk) {
  desk.use(requireAuth);
  desk.get('/berths', list);
  desk.get('/berths/:pier', show);
  desk.patch('/berths/:pier', move);
  known.get(pier);
}
"""
TIDES = """export default function tides(desk) {
  desk.post('/readings', store);
  desk.delete('/readings/:hour', erase);
}
"""
HARBOUR = [
    ("harbour", "package.json", PACKAGE),
    ("harbour", "COPYING", "All yours.\n"),
    ("harbour", "src/server.js", SERVER),
    ("harbour", "src/berths/handlers.js", BERTHS),
    ("harbour", "src/tides.js", TIDES),
    ("harbour", "src/guards/badge.js", "export const requireAuth = (request) => request.badge;\n"),
]

CHART = [
    ("chart", "package.json", '{"name": "sea-chart", "dependencies": {"vue": "^3.4.0"}, "devDependencies": {"vite": "^5.0.0"}}'),
    ("chart", "vite.config.js", "export default {};\n"),
    ("chart", "src/main.js", "import { createApp } from 'vue';\nimport { depth } from './soundings';\ncreateApp({ depth });\n"),
    ("chart", "src/soundings.js", "export function depth(x, y) {}\n"),
]

# Four packages of a fleet: two need the units, the cabin needs the other two.
FLEET = [
    ("fleet", "package.json", '{"name": "fleet", "private": true, "workspaces": ["modules/*"]}'),
    ("fleet", "modules/units/package.json", '{"name": "@fleet/units", "version": "2.0.0"}'),
    ("fleet", "modules/units/tsconfig.json", "{}"),
    ("fleet", "modules/engine/package.json", '{"name": "@fleet/engine", "dependencies": {"@fleet/units": "*", "fastify": "^4.0.0"}}'),
    ("fleet", "modules/engine/tsconfig.json", "{}"),
    ("fleet", "modules/engine/src/main.ts", "import fastify from 'fastify';\nengine.get('/speed', read);\nengine.put('/speed', set);\n"),
    ("fleet", "modules/dials/package.json", '{"name": "@fleet/dials", "dependencies": {"@fleet/units": "*", "vue": "^3.4.0"}}'),
    ("fleet", "modules/cabin/package.json", '{"name": "@fleet/cabin", "dependencies": {"@fleet/dials": "*", "@fleet/engine": "*"}}'),
    ("fleet", "modules/cabin/tsconfig.json", "{}"),
]
