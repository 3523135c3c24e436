"""A typed registry of surface features, as DataFrames.

``features`` has `FEATURES`, ``relations`` has ``child_id, parent_id``. Rows are
immutable, so indexes, groups and relations are always derived, never kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partialmethod

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from cavitas.functions import labels as L
from cavitas.functions.checks import ArgumentError, one_of
from cavitas.operators.numbering import numbered, running_max
from cavitas.session import cut

FEATURES = (
    "feature_id string, seq long, feature_type string, shape_type string, dimensionality int, feature_label string, source string, source_id string,"
    " atom_indices array<int>, atom_labels array<string>, atom_label_format string, sa_area double, ms_area double, sa_volume double, ms_volume double,"
    " sa_length double, ms_length double, length double, corner_points_count int, n_triangles int, extra map<string,string>"
)
RELATIONS = "child_id string, parent_id string"
SOURCE = "cavitas"

#: The types of each shape. Of a type in two shapes the later shape holds.
TYPES_OF_SHAPE = {
    "point": ["feature0d", "point", "pit", "apex", "summit", "bifurcation", "saddle_point", "ridge_tip"],
    "boundary": ["feature1d", "mouth", "base_rim", "neck", "ridge", "furrow", "lip", "seam", "isthmus", "edge_loop", "branch_line", "hinge_line"],
    "concavity": ["void", "pocket", "channel", "branched_channel", "groove", "funnel", "vestibule", "ampulla", "alcove"],
    "convexity": ["protrusion", "dome", "ridge", "spine", "bulge", "ridge_cap", "knob", "buttress", "pinnacle"],
    "mixed": ["feature2d", "interface", "patch", "joint", "saddle", "trench"],
}
DIMENSIONS = {"point": 0, "boundary": 1, "concavity": 2, "convexity": 2, "mixed": 2}
#: Id prefixes; other types take their first three letters.
PREFIXES = {"base_feature": "BSF", "feature0d": "F0D", "feature1d": "F1D", "feature2d": "F2D", "pocket": "POC", "void": "VOI", "mouth": "MOU", "channel": "CHA", "branched_channel": "BCH"}
SHAPE_OF_TYPE = {t: shape for shape, types in TYPES_OF_SHAPE.items() for t in types}


def type_name(name: str) -> str:
    """A type in lower case; ``feature_1d`` and ``Feature1D`` are ``feature1d``."""
    plain = name.lower() if isinstance(name, str) else name
    if isinstance(plain, str) and plain.replace("_", "") in ("feature0d", "feature1d", "feature2d"):
        plain = plain.replace("_", "")
    return one_of(plain, {*SHAPE_OF_TYPE, "base_feature"}, "feature_type")


def taxonomy(spark: SparkSession) -> DataFrame:
    """``feature_type, shape_type, dimensionality, prefix``: 43 types, a fixed size."""
    rows = [(t, s, DIMENSIONS[s], PREFIXES.get(t, t[:3].upper())) for t, s in SHAPE_OF_TYPE.items()]
    return spark.createDataFrame(rows, "feature_type string, shape_type string, dimensionality int, prefix string")


def with_taxonomy(features: DataFrame) -> DataFrame:
    """``features`` with shape, dimensionality and prefix of their type; an unknown type raises."""
    rows = features.drop("shape_type", "dimensionality", "prefix")
    joined = rows.join(F.broadcast(taxonomy(features.sparkSession)), "feature_type", "left")
    known = F.when(F.col("shape_type").isNotNull() | (F.col("feature_type") == "base_feature"), F.col("shape_type")).otherwise(F.raise_error(F.concat(F.lit("unknown feature type: "), F.coalesce("feature_type", F.lit("null")))).cast("string"))
    return joined.withColumn("shape_type", known).withColumn("prefix", F.coalesce("prefix", F.upper(F.substring("feature_type", 1, 3))))


def next_ids(new: DataFrame, existing: DataFrame | None = None, order: str = "seq") -> DataFrame:
    """``new`` (feature_type, ``order``, ...) with ``feature_id``: the prefix and the next free numbers of the type.

    Numbers follow the count of existing features of the type and skip ids in use. Those above the count are turned into
    gaps: a used number with f free numbers before it moves all new ones after the f-th, and the new ones meet these steps
    in one order, where each takes the last step before it. No type is one task, and nothing that grows with ids is broadcast.
    """
    rows = numbered(new if "prefix" in new.columns else with_taxonomy(new), ["feature_type"], [order], "__k")
    if existing is None:
        return rows.withColumn("feature_id", F.concat("prefix", F.lit("-"), F.col("__k").cast("string"))).drop("__k")
    held = existing.groupBy("feature_type").agg(F.count("*").alias("__held"))  # a row a type
    names = F.broadcast(taxonomy(existing.sparkSession).select("feature_type", "prefix"))
    used = existing.select("feature_id").distinct().withColumn("prefix", F.substring_index("feature_id", "-", 1))
    used = used.where(F.col("feature_id").rlike("^[^-]+-[1-9][0-9]{0,17}$")).withColumn("n", F.substring_index("feature_id", "-", -1).cast("long"))
    used = used.join(names, "prefix").join(F.broadcast(held), "feature_type", "left").where(F.col("n") > F.coalesce("__held", F.lit(0)))
    used = numbered(used, ["feature_type"], ["n"], "rank").withColumn("free", F.col("n") - F.coalesce("__held", F.lit(0)) - F.col("rank"))
    steps = used.groupBy("feature_type", "free").agg(F.max("rank").alias("__skipped"))  # the same for a run of used numbers
    columns = rows.columns
    places = rows.withColumns({"__at": F.col("__k"), "__new": F.lit(1), "__skipped": F.lit(None).cast("long")})
    steps = steps.select("feature_type", (F.col("free") + 1).alias("__at"), F.lit(0).alias("__new"), "__skipped")
    met = running_max(places.unionByName(steps, allowMissingColumns=True), ["feature_type"], ["__at", "__new"], "__skipped", "__past").where("__new = 1")
    met = met.select(*columns, "__past").join(F.broadcast(held), "feature_type", "left")
    number = F.col("__k") + F.coalesce("__held", F.lit(0)) + F.col("__past")
    return met.withColumn("feature_id", F.concat("prefix", F.lit("-"), number.cast("string"))).drop("__held", "__past", "__k")


def applies_to(spark: SparkSession) -> DataFrame:
    """``feature_type, shape_type``: the shapes whose features a 0-D or 1-D type may belong to, a fixed size."""
    surfaces = [s for s, d in DIMENSIONS.items() if d == 2]
    only = {"mouth": ["concavity"], "base_rim": ["convexity"]}
    return spark.createDataFrame([(t, s) for t, shape in SHAPE_OF_TYPE.items() if DIMENSIONS[shape] < 2 for s in only.get(t, surfaces)], "feature_type string, shape_type string")


def info(features: DataFrame) -> DataFrame:
    """``kind, name, n``: counts in total and by type, and by shape and dimensionality with zeros for absent ones."""
    spark = features.sparkSession
    rows = features.select("feature_type", "shape_type", F.col("dimensionality").cast("string").alias("dimensionality"))
    count = lambda kind, column: rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("name")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "name", "n")
    found = count("type", "feature_type").unionByName(count("shape", "shape_type")).unionByName(count("dimensionality", "dimensionality"))
    domain = spark.createDataFrame([("shape", s) for s in DIMENSIONS] + [("dimensionality", str(d)) for d in (0, 1, 2)], "kind string, name string")
    filled = domain.join(found, ["kind", "name"], "full").withColumn("n", F.coalesce("n", F.lit(0)))
    total = rows.agg(F.count("*").alias("n")).select(F.lit("total").alias("kind"), F.lit("total").alias("name"), "n")
    return filled.select("kind", "name", "n").unionByName(total)


BY = {"type": "feature_type", "shape": "shape_type", "dimensionality": "dimensionality", "id": "feature_id"}


def get_features(features: DataFrame, by: str | None = None, value=None, grouped_by: str | None = None) -> DataFrame:
    """Features with a type, shape, dimensionality or (one or several) ids; an unknown value finds none.

    ``grouped_by`` type, shape or dimensionality gives ``key, feature_ids`` instead.
    """
    if by is not None:
        column = BY[one_of(by, BY, "by")]
        several = isinstance(value, (list, tuple, set))
        if several and by != "id":
            raise ArgumentError(f"value: one {by} is needed, not {value!r}")
        chosen = list(value) if several else [value]
        features = features.where(F.col(column).isin(*chosen) if chosen else F.lit(False))
    if grouped_by is None:
        return features
    key = BY[one_of(grouped_by, set(BY) - {"id"}, "grouped_by")]
    return features.groupBy(F.col(key).alias("key")).agg(F.array_sort(F.collect_list("feature_id")).alias("feature_ids"))


def children_of(features: DataFrame, relations: DataFrame, parents: DataFrame | None = None) -> DataFrame:
    """``parent_id`` and the child's columns, of all relations or of the parents (``feature_id``) given."""
    if parents is not None:
        relations = relations.join(parents.select(F.col("feature_id").alias("parent_id")).distinct(), "parent_id", "left_semi")
    return relations.join(features.withColumnRenamed("feature_id", "child_id"), "child_id")


def parents_of(features: DataFrame, relations: DataFrame, children: DataFrame | None = None) -> DataFrame:
    """``child_id`` and the parent's columns."""
    if children is not None:
        relations = relations.join(children.select(F.col("feature_id").alias("child_id")).distinct(), "child_id", "left_semi")
    return relations.join(features.withColumnRenamed("feature_id", "parent_id"), "parent_id")


def violations(features: DataFrame, relations: DataFrame) -> DataFrame:
    """``child_id, parent_id, rule`` of relations that break a rule: the first of

    ``unknown`` id, ``parent_not_2d``, ``child_not_0d_1d``, ``mouth_needs_concavity``, ``base_rim_needs_convexity``.
    """
    kind = features.select("feature_id", "feature_type", "shape_type", "dimensionality")
    side = lambda name: kind.select(*[F.col(c).alias(f"{name}_{c}" if c != "feature_id" else f"{name}_id") for c in kind.columns])
    rows = relations.join(side("child"), "child_id", "left").join(side("parent"), "parent_id", "left")
    rule = (
        F.when(F.col("child_feature_type").isNull() | F.col("parent_feature_type").isNull(), "unknown")
        .when(F.coalesce(F.col("parent_dimensionality") != 2, F.lit(True)), "parent_not_2d")
        .when(~F.coalesce(F.col("child_dimensionality").isin(0, 1), F.lit(False)), "child_not_0d_1d")
        .when((F.col("child_feature_type") == "mouth") & (F.col("parent_shape_type") != "concavity"), "mouth_needs_concavity")
        .when((F.col("child_feature_type") == "base_rim") & (F.col("parent_shape_type") != "convexity"), "base_rim_needs_convexity")
    )
    return rows.select("child_id", "parent_id", rule.alias("rule")).where("rule IS NOT NULL")


def related_ids(features: DataFrame, relations: DataFrame) -> DataFrame:
    """``feature_id, boundaries, points, surfaces``: ids of 1-D and 0-D children, and of parents, sorted."""
    kind = features.select(F.col("feature_id").alias("child_id"), "dimensionality")
    down = relations.distinct().join(kind, "child_id").groupBy(F.col("parent_id").alias("feature_id"))
    ids = lambda d: F.array_sort(F.collect_list(F.when(F.col("dimensionality") == d, F.col("child_id"))))
    down = down.agg(ids(1).alias("boundaries"), ids(0).alias("points"))
    up = relations.distinct().groupBy(F.col("child_id").alias("feature_id")).agg(F.array_sort(F.collect_list("parent_id")).alias("surfaces"))
    none = F.array().cast("array<string>")
    out = features.select("feature_id").join(down, "feature_id", "left").join(up, "feature_id", "left")
    return out.select("feature_id", *[F.coalesce(c, none).alias(c) for c in ("boundaries", "points", "surfaces")])


def records(features: DataFrame) -> DataFrame:
    return features.select("feature_id", "feature_type", "shape_type", "dimensionality")


def natural_order(features: DataFrame, column: str = "feature_id") -> DataFrame:
    return features.orderBy(*L.natural_key(F.col(column)))


def descriptions(features: DataFrame) -> DataFrame:
    """``feature_id, feature_type, shape_type, description``, such as ``<BaseRim with feature_id=BAS-1>``; without an id, ``None``."""
    words = F.replace(F.initcap(F.replace("feature_type", F.lit("_"), F.lit(" "))), F.lit(" "), F.lit(""))
    name = F.when(F.col("feature_type").rlike("^feature[012]d$"), F.regexp_replace(words, "d$", "D")).otherwise(words)
    text = F.concat(F.lit("<"), F.coalesce(name, F.lit("None")), F.lit(" with feature_id="), F.coalesce("feature_id", F.lit("None")), F.lit(">"))
    return features.select("feature_id", "feature_type", "shape_type", text.alias("description"))


def feature_atoms(features: DataFrame, atoms: DataFrame) -> DataFrame:
    """``feature_id, place`` (from 0, in ``atom_indices``) and the atom's columns, of each feature's atoms.

    A feature whose ``extra`` names a ``system_id`` has its atoms there, any other in every system of the table.
    Features without indices, and indices without an atom, give no rows.
    """
    system = F.try_element_at(F.coalesce("extra", F.create_map().cast("map<string,string>")), F.lit("system_id"))
    rows = features.select("feature_id", system.alias("__system"), F.posexplode("atom_indices").alias("place", "atom_index"))
    named = rows.where("__system IS NOT NULL").withColumnRenamed("__system", "system_id").join(atoms, ["system_id", "atom_index"])
    everywhere = rows.where("__system IS NULL").drop("__system").join(atoms, "atom_index")
    columns = ["feature_id", "place", *atoms.columns]
    return named.select(columns).unionByName(everywhere.select(columns))


class Feature:
    """One feature of a registry: its row's columns as attributes, and what belongs to it as tables."""

    def __init__(self, registry: Registry, row: Row):
        self.registry, self.row = registry, row

    def __getattr__(self, name: str):
        if name in ("row", "registry") or name not in self.row.__fields__:
            raise AttributeError(name)
        return self.row[name]

    @property
    def id(self) -> str:
        return self.row["feature_id"]

    @property
    def molecular_system(self) -> DataFrame | None:
        return self.registry.atoms

    def atoms(self) -> DataFrame | None:
        """`feature_atoms` of this one; None where no system is attached."""
        one = self.registry.features.where(F.col("feature_id") == self.id)
        return None if self.registry.atoms is None else feature_atoms(one, self.registry.atoms)

    def children(self) -> DataFrame:
        return self.registry.children_of(self.id)

    def parents(self) -> DataFrame:
        return self.registry.parents_of(self.id)

    def info(self) -> dict[str, object]:
        return {name: self.row[name] for name in ("feature_id", "feature_type", "shape_type", "dimensionality")}

    def __repr__(self) -> str:
        one = self.registry.spark.createDataFrame([tuple(self.info().values())[:3]], "feature_id string, feature_type string, shape_type string")
        return descriptions(one).first()["description"]


class Registry:
    """The tables with their rules: a thin facade, each change gives a new registry."""

    def __init__(self, spark: SparkSession, features: DataFrame | None = None, relations: DataFrame | None = None, atoms: DataFrame | None = None):
        self.spark = spark
        self.features = features if features is not None else spark.createDataFrame([], FEATURES)
        self.relations = relations if relations is not None else spark.createDataFrame([], RELATIONS)
        self.atoms = atoms

    def _with(self, **changes) -> Registry:
        return Registry(self.spark, **({"features": self.features, "relations": self.relations, "atoms": self.atoms} | changes))

    def with_atoms(self, atoms: DataFrame | None) -> Registry:
        """Attaches a system; labels of features without indices are resolved against it."""
        made = self._with(atoms=atoms)
        return made if atoms is None else made._with(features=made._resolved(made.features))

    def _resolved(self, features: DataFrame) -> DataFrame:
        formats = [r[0] for r in features.where("atom_labels IS NOT NULL AND atom_indices IS NULL").select("atom_label_format").distinct().collect()]
        system = F.try_element_at(F.coalesce("extra", F.create_map().cast("map<string,string>")), F.lit("system_id"))
        for template in formats:  # as many as there are label formats, a handful
            todo = features.where((F.col("atom_label_format") == template) & F.col("atom_indices").isNull() & F.col("atom_labels").isNotNull())
            rows = todo.select("feature_id", system.alias("system"), F.posexplode("atom_labels").alias("at", "label"))
            # a feature of a named system has its atoms there, any other where the label is found
            one = L.resolve(rows.where("system IS NOT NULL").withColumnRenamed("system", "system_id"), self.atoms, template, keys=("system_id",))
            any_ = L.resolve(rows.where("system IS NULL").drop("system"), self.atoms, template)
            found = one.select(*any_.columns).unionByName(any_).groupBy("feature_id").agg(F.array_sort(F.collect_list(F.struct("at", "atom_index"))).alias("s"))
            found = found.select("feature_id", F.transform("s", lambda x: x["atom_index"].cast("int")).alias("__found"))
            features = features.join(found, "feature_id", "left").withColumn("atom_indices", F.coalesce("atom_indices", "__found")).drop("__found")
        return features.select(*self.features.columns)

    def add(self, new: DataFrame, on_duplicate: str = "replace") -> Registry:
        """Adds rows with any of the columns; missing ids are generated, none that is in use.

        Of rows with an id that is there or comes twice the last stays (replace), the first (skip), or it is an error.
        """
        one_of(on_duplicate, ("replace", "skip", "error"), "on_duplicate")
        base = self.features.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("top")).first()["top"]
        kinds = dict(self.spark.createDataFrame([], FEATURES).dtypes)
        have = new.select(*[F.col(c).cast(kinds[c]).alias(c) if c in new.columns else F.lit(None).cast(kinds[c]).alias(c) for c in kinds])
        have = numbered(have.withColumn("__at", F.coalesce("seq", F.monotonically_increasing_id())), [], ["__at"], "__number")
        have = cut(with_taxonomy(have.withColumn("seq", F.lit(base) + F.col("__number")).drop("__at", "__number")))
        named = have.where("feature_id IS NOT NULL")
        once = named.groupBy("feature_id").agg(F.min("seq").alias("first"), F.max("seq").alias("last"))
        if on_duplicate == "error" and not once.where("first < last").isEmpty():
            raise ArgumentError("a feature id comes twice")
        stays = once.select("feature_id", F.col("first" if on_duplicate == "skip" else "last").alias("seq"))
        named = named.join(stays, ["feature_id", "seq"], "left_semi")
        taken = self.features.select("feature_id", "feature_type").unionByName(named.join(self.features, "feature_id", "left_anti").select("feature_id", "feature_type"))
        fresh = next_ids(have.where("feature_id IS NULL"), taken)
        rows = named.unionByName(fresh.select(*named.columns))
        none = F.lit(None).cast("array<string>")
        rows = rows.withColumns({"source": F.coalesce("source", F.lit(SOURCE)), "source_id": F.coalesce("source_id", "feature_id"), "atom_label_format": F.coalesce("atom_label_format", F.lit(L.DEFAULT_FORMAT)), "atom_labels": F.coalesce("atom_labels", none)})
        rows = rows.select(*kinds)
        held = self.features
        if on_duplicate == "skip":
            rows = rows.join(held.select("feature_id"), "feature_id", "left_anti").select(*kinds)
        elif on_duplicate == "error" and not rows.join(held.select("feature_id"), "feature_id", "left_semi").isEmpty():
            raise ArgumentError("a feature id is already there")
        else:
            held = held.join(rows.select("feature_id"), "feature_id", "left_anti").select(*kinds)
        made = self._with(features=cut(held.unionByName(rows)))
        return made if self.atoms is None else made._with(features=made._resolved(made.features))

    def add_new(self, feature_type: str, feature_id: str | None = None, atom_indices=None, atom_labels=None, atom_label_format: str | None = None, on_duplicate: str = "replace", **more) -> Registry:
        """Adds one feature; columns of `FEATURES` may follow, other names go to ``extra``."""
        kinds = dict(self.spark.createDataFrame([], FEATURES).dtypes)
        row = {"feature_type": type_name(feature_type), "feature_id": feature_id, "atom_indices": list(atom_indices) if atom_indices is not None else None}
        row |= {"atom_labels": sorted(atom_labels) if isinstance(atom_labels, (set, frozenset)) else atom_labels, "atom_label_format": atom_label_format}
        row |= {k: v for k, v in more.items() if k in kinds}
        row["extra"] = {k: str(v) for k, v in ((more.get("extra") or {}) | {k: v for k, v in more.items() if k not in kinds}).items()} or None
        return self.add(self.spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {kinds[k]}" for k in row)), on_duplicate)

    def connect(self, child_id: str, parent_id: str) -> Registry:
        return self.connect_all(self.spark.createDataFrame([(child_id, parent_id)], RELATIONS))

    def connect_surfaces(self, child_id: str, *surface_ids: str) -> Registry:
        """A boundary or point belongs to these surfaces."""
        return self.connect_all(self.spark.createDataFrame([(child_id, s) for s in surface_ids], RELATIONS))

    def connect_boundaries(self, surface_id: str, *boundary_ids: str) -> Registry:
        """These boundaries (or points) belong to a surface."""
        return self.connect_all(self.spark.createDataFrame([(b, surface_id) for b in boundary_ids], RELATIONS))

    connect_points = connect_boundaries

    def connect_all(self, relations: DataFrame) -> Registry:
        """Adds relations that break no rule; the first that does is named in the error."""
        wrong = violations(self.features, relations).orderBy("child_id", "parent_id").first()
        if wrong:
            raise ArgumentError(f"{wrong['child_id']} can't belong to {wrong['parent_id']}: {wrong['rule']}")
        return self._with(relations=self.relations.unionByName(relations.select("child_id", "parent_id")).distinct())

    def get(self, by: str | None = None, value=None, grouped_by: str | None = None) -> DataFrame:
        return get_features(self.features, by, value, grouped_by)

    def __getitem__(self, feature_id: str):
        found = self.features.where(F.col("feature_id") == feature_id).first()
        if found is None:
            raise KeyError(feature_id)
        return found

    def __contains__(self, feature_id: str) -> bool:
        return not self.features.where(F.col("feature_id") == feature_id).isEmpty()

    def __len__(self) -> int:
        return self.features.count()

    def __iter__(self):
        return (r["feature_id"] for r in self.features.select("feature_id", "seq").orderBy("seq").toLocalIterator())

    def find(self, feature_id: str, default=None):
        """The feature with an id, or ``default``."""
        return self.features.where(F.col("feature_id") == feature_id).first() or default

    def keys(self) -> Iterator[str]:
        return iter(self)

    def values(self) -> Iterator[Row]:
        """Features as they were added, a partition at a time."""
        return self.features.orderBy("seq").toLocalIterator()

    def items(self) -> Iterator[tuple[str, Row]]:
        return ((r["feature_id"], r) for r in self.values())

    def copy(self, deep: bool = False) -> Registry:
        """Tables do not change, so that a copy shares them; a deep one has checkpoints of its own, which outlive its sources."""
        return self._with(**{name: cut(t) for name, t in (("features", self.features), ("relations", self.relations), ("atoms", self.atoms)) if t is not None}) if deep else self._with()

    @property
    def molecular_system(self) -> DataFrame | None:
        return self.atoms

    def feature(self, feature_id: str) -> Feature:
        """A view of the feature with an id."""
        return Feature(self, self[feature_id])

    def atoms_of_features(self) -> DataFrame:
        """`feature_atoms` of all features."""
        if self.atoms is None:
            raise ArgumentError("no molecular system is attached")
        return feature_atoms(self.features, self.atoms)

    def next_id(self, feature_type: str) -> str:
        """The id that the next feature of a type gets."""
        one = self.spark.createDataFrame([(type_name(feature_type), 1)], "feature_type string, seq long")
        return next_ids(one, self.features).first()["feature_id"]

    def children_of(self, feature_id: str) -> DataFrame:
        self[feature_id]
        return children_of(self.features, self.relations.where(F.col("parent_id") == feature_id))

    def parents_of(self, feature_id: str) -> DataFrame:
        self[feature_id]
        return parents_of(self.features, self.relations.where(F.col("child_id") == feature_id))

    def info(self) -> DataFrame:
        return info(self.features)

    def describe(self) -> DataFrame:
        return descriptions(self.features)

    def __repr__(self) -> str:
        counts = self.features.groupBy("feature_type").count().orderBy("feature_type").collect()  # types are few
        return f"<Registry {', '.join(f'{t}={n}' for t, n in counts)}>"


for _type in SHAPE_OF_TYPE:  # add_new_pocket(...), add_new_void(...), ...
    setattr(Registry, f"add_new_{_type}", partialmethod(Registry.add_new, _type))


def extra(name: str) -> Column:
    """An open attribute of a feature."""
    return F.col("extra")[name]
