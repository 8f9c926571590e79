"""Saved queries over the library, as verbs of the rule language."""

VERBS = r"""
@verb(name: "handle", doc: "A handle, its edges and neighbours.", args: "id: String", query: "
  row(\"self\", h, k) := verb_arg(\"id\", h), *handle{id: h, kind: k}.
  row(\"in\", o, k) := verb_arg(\"id\", h), incoming_edge(h, o, k).
  row(\"out\", o, k) := verb_arg(\"id\", h), outgoing_edge(h, o, k).
  ? row(side, other, kind).").
@verb(name: "search", doc: "The best hits of a query.", args: "query: String, limit: Int = 25", query: "
  hit(h, span, s, why) := verb_arg(\"query\", q), search(q, h, span, s, why, f, false).
  ? verb_arg(\"limit\", n), (h, span, score, why) = TopK{ k: n, key: score : (h, span, score, why) : hit(h, span, score, why) }.").
@verb(name: "read", doc: "Spans of a handle within a budget.", args: "handle: String, budget: Int = 4000", query: "
  ? verb_arg(\"handle\", h), verb_arg(\"budget\", b), read(h, b, span, text, from_line, to_line, tokens).").
@verb(name: "context", doc: "Hits of a query with spans to read and what is near.", args: "query: String, budget: Int = 4000", query: "
  hit(h, s) := verb_arg(\"query\", q), search(q, h, span, s, why, f, false).
  best(h, s) := (h, s) = TopK{ k: 10, key: s : (h, s) : hit(h, s) }.
  part(\"hit\", h, d, s) := best(h, s), hit_currency_disposition(h, d).
  part(\"near\", o, h, 0.0) := best(h, s), incident(h, o), not best(o, _).
  ? part(what, h, detail, score).").
@verb(name: "status", doc: "Counts of the corpus by category.", query: "
  section(s) := status_item(s, h, e, w).
  level(s) := diagnostic(c, s, x, f, l, e).
  metric(\"work\", s, n) := section(s), n = Count{ h : status_item(s, h, e, w) }.
  metric(\"findings\", s, n) := level(s), n = Count{ x : diagnostic(c, s, x, f, l, e) }.
  metric(\"scale\", \"handles\", n) := n = Count{ h : *handle{id: h} }.
  metric(\"scale\", \"edges\", n) := n = Count{ i : *edge{native_id: i} }.
  ? metric(category, name, count).").
@verb(name: "check", doc: "Errors.", query: "? diagnostic(code, \"error\", subject, file, line, evidence).").
@verb(name: "schema", doc: "Relations, primitives and predicates.", query: "? schema(name, kind, signature, determinism, provenance).").
@verb(name: "predicates", doc: "Derived predicates.", query: "? predicates(name, doc, file, lines).").
@verb(name: "describe", doc: "Documentation of a name.", args: "name: String", query: "? verb_arg(\"name\", n), describe(n, doc).").
@verb(name: "source-of", doc: "Where a predicate is defined.", args: "name: String", query: "? verb_arg(\"name\", n), source_of(n, file, lines).").
""".replace("\n  ", " ")
