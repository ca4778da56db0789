"""SQL with the results of the catalogue queries, for DuckDB over the same Parquet tables.

Statements are put together from named common table expressions; a statement gets those it mentions.
Spark rounds the decimal form of a double, DuckDB its binary form: where a value can fall on a tie,
the SQL rounds a decimal too.
"""

from __future__ import annotations

import re

NUTRIENTS = ("CALORIES", "FAT", "PROTEIN", "FIBER", "SUGARS", "SODIUM")
SCORES = {
    "NUTRITION_SIMILARITY": ("SCALED_NUTRITION_SIMILARITY", "avgN"),
    "ING_ABSOLUTE_SIMILARITY": ("SCALED_ING_ABSOLUTE_SIMILARITY", "absI"),
    "IDF_SIMILARITY": ("SCALED_IDF_SIMILARITY", "weightI"),
    "ABS_NUT_SIMILARITY": ("SCALED_ABS_NUT_SIMILARITY", "absN"),
    "IDF_NUT_SIMILARITY": ("SCALED_IDF_NUT_SIMILARITY", "weightN"),
}
KS = (5, 10, 30)


def _each(template: str, names=NUTRIENTS, sep: str = ", ") -> str:
    return sep.join(template.format(c=c) for c in names)


def _decimal_round(value: str, digits: int) -> str:
    return f"CAST(round(CAST({value} AS DECIMAL(28,12)), {digits}) AS DOUBLE)"


def _fraction(*columns: str, seed: int = 0) -> str:
    key = ", ".join(columns)
    return f"CAST('0x' || substr(md5(concat_ws(':', {key}, '{seed}')), 1, 8) AS BIGINT) / 4294967296.0"


def _rating(value: str) -> str:
    return (
        f"CAST(CASE WHEN {value} < 0 THEN floor({value}) WHEN {value} < 0.5 THEN 0 "
        f"ELSE ceil({value}) END AS INTEGER)"
    )


CTES: dict[str, str] = {
    "interactions": """
        SELECT o_custkey AS USER_ID, l_partkey AS RECIPE_ID,
               CASE WHEN l_returnflag = 'N' THEN 'review' WHEN l_returnflag = 'A' THEN 'recipes'
                    WHEN l_linestatus = 'F' THEN 'fav' ELSE 'madeit' END AS RECIPE_TYPE,
               CAST(ceil(l_quantity / 10) AS INTEGER) AS RATING,
               l_orderkey * 100 + l_linenumber AS ID
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "raw_ingredients": "SELECT DISTINCT l_partkey AS RECIPE_ID, l_suppkey AS ID_INGREDIENT FROM lineitem",
    "ingredients": "SELECT * FROM raw_ingredients WHERE ID_INGREDIENT <> 0",
    "nutrition": """
        SELECT p_partkey AS RECIPE_ID,
               CAST(CASE WHEN p_brand = 'Brand#7' THEN 0 ELSE p_size END AS DOUBLE) AS CALORIES,
               CAST(p_partkey % 17 AS DOUBLE) AS FAT, CAST(p_partkey % 23 AS DOUBLE) AS PROTEIN,
               CAST(p_partkey % 7 AS DOUBLE) AS FIBER, CAST(p_partkey % 11 AS DOUBLE) AS SUGARS,
               CAST(p_partkey % 31 AS DOUBLE) AS SODIUM
        FROM part WHERE p_size < 50""",
    "reviews": """
        SELECT USER_ID, RECIPE_ID, max(RATING) AS RATING
        FROM interactions WHERE RECIPE_TYPE = 'review' GROUP BY USER_ID, RECIPE_ID""",
    "lines": "SELECT l_orderkey AS ID_RECIPE, l_suppkey AS ID_INGREDIENT FROM lineitem WHERE l_suppkey <> 0",
    "baskets": "SELECT DISTINCT ID_RECIPE, ID_INGREDIENT FROM lines",
    "ingredient_text": """
        SELECT p_partkey AS LINE_NO, p_partkey % 100 AS ID_INGREDIENT,
               concat(CAST(p_size AS VARCHAR), ' cups ', p_name, ', ', lower(p_type)) AS TEXT_VALUE
        FROM part""",
    "difficulty": """
        SELECT ID, SOURCE, COOK_TIME, N_INGREDIENTS, N_STEPS,
               CASE WHEN Q < 60 THEN 'easy' WHEN Q < 140 THEN 'medium' ELSE 'hard' END AS DIFFICULTY
        FROM (SELECT l_orderkey AS ID, l_orderkey % 4 AS SOURCE, sum(l_quantity) AS Q,
                     CAST(CASE WHEN l_orderkey % 20 = 0 THEN 0 ELSE sum(l_quantity) END AS INTEGER) AS COOK_TIME,
                     CAST(count(DISTINCT l_suppkey) AS INTEGER) AS N_INGREDIENTS,
                     CAST(count(*) AS INTEGER) AS N_STEPS
              FROM lineitem GROUP BY l_orderkey)""",
    "user_roles": """
        SELECT USER_ID AS ID_USER, RECIPE_ID AS ID_RECIPE,
               CASE WHEN RECIPE_TYPE = 'review' THEN 'reviewer' ELSE 'author' END AS ROLE
        FROM interactions""",
    "bucketed": """
        SELECT USER_ID, RECIPE_ID, RATING, ID,
               CASE WHEN RECIPE_TYPE IN ('recipes', 'madeit', 'fav') THEN 'recipes' ELSE 'reviews' END AS "type"
        FROM interactions""",
    "stats": """
        SELECT USER_ID, count(*) FILTER (WHERE "type" = 'recipes') AS total_recipes,
               count(*) FILTER (WHERE "type" = 'reviews') AS total_reviews
        FROM bucketed GROUP BY USER_ID""",
    # content-based recommender
    "valid": """
        SELECT p_partkey AS RECIPE_ID FROM part
        WHERE p_partkey IN (SELECT RECIPE_ID FROM ingredients)
          AND p_partkey IN (SELECT RECIPE_ID FROM nutrition)
          AND p_partkey NOT IN (SELECT RECIPE_ID FROM nutrition WHERE CALORIES = 0)""",
    "valid_ingredients": "SELECT * FROM ingredients WHERE RECIPE_ID IN (SELECT RECIPE_ID FROM valid)",
    "valid_nutrition": "SELECT * FROM nutrition WHERE RECIPE_ID IN (SELECT RECIPE_ID FROM valid)",
    "valid_bucketed": "SELECT * FROM bucketed WHERE RECIPE_ID IN (SELECT RECIPE_ID FROM valid)",
    "eligible": """
        SELECT USER_ID FROM valid_bucketed GROUP BY USER_ID
        HAVING count(*) FILTER (WHERE "type" = 'reviews') >= 10
           AND count(*) FILTER (WHERE "type" = 'recipes') >= 30""",
    "training": """
        SELECT DISTINCT USER_ID, RECIPE_ID FROM valid_bucketed
        WHERE "type" = 'recipes' AND USER_ID IN (SELECT USER_ID FROM eligible)""",
    "test": """
        SELECT DISTINCT b.USER_ID, b.RECIPE_ID, r.RATING
        FROM valid_bucketed b JOIN reviews r ON b.USER_ID = r.USER_ID AND b.RECIPE_ID = r.RECIPE_ID
        WHERE "type" = 'reviews' AND b.USER_ID IN (SELECT USER_ID FROM eligible)""",
    "idf": f"""
        SELECT ID_INGREDIENT,
               {_decimal_round("log10((SELECT count(*) FROM valid) / count(*))", 4)} AS IDF
        FROM valid_ingredients GROUP BY ID_INGREDIENT""",
    "nutrition_profile": f"""
        SELECT USER_ID, {", ".join(f"{_decimal_round(f'avg({c})', 3)} AS {c}" for c in NUTRIENTS)}
        FROM training JOIN valid_nutrition USING (RECIPE_ID) GROUP BY USER_ID""",
    "ingredient_profile": f"""
        SELECT USER_ID, ID_INGREDIENT, count(*) AS ABSOLUTE_FREQUENCY,
               {_decimal_round("count(*) * max(IDF)", 4)} AS N_IDF
        FROM training JOIN valid_ingredients USING (RECIPE_ID) JOIN idf USING (ID_INGREDIENT)
        GROUP BY USER_ID, ID_INGREDIENT""",
    "nutrition_scores": f"""
        SELECT t.USER_ID, t.RECIPE_ID, t.RATING,
               CASE WHEN n.RECIPE_ID IS NULL THEN 0.0 ELSE round(
                 ({_each("p.{c} * n.{c}", sep=" + ")})
                 / nullif(sqrt({_each("p.{c} * p.{c}", sep=" + ")})
                          * sqrt({_each("n.{c} * n.{c}", sep=" + ")}), 0), 10) END AS NUTRITION_SIMILARITY
        FROM test t LEFT JOIN valid_nutrition n ON t.RECIPE_ID = n.RECIPE_ID
             LEFT JOIN nutrition_profile p ON t.USER_ID = p.USER_ID""",
    "user_norms": """
        SELECT USER_ID, sqrt(sum(ABSOLUTE_FREQUENCY * ABSOLUTE_FREQUENCY)) AS norm_n,
               sqrt(sum(N_IDF * N_IDF)) AS norm_idf
        FROM ingredient_profile GROUP BY USER_ID""",
    "ingredient_scores": """
        SELECT USER_ID, RECIPE_ID, RATING,
               CASE WHEN size = 0 THEN 0.0
                    ELSE round(dot_n / nullif(norm_n * sqrt(size), 0), 10) END AS ING_ABSOLUTE_SIMILARITY,
               CASE WHEN size = 0 THEN 0.0
                    ELSE round(dot_idf / nullif(norm_idf * sqrt(size), 0), 10) END AS IDF_SIMILARITY
        FROM (SELECT t.USER_ID, t.RECIPE_ID, t.RATING, count(i.ID_INGREDIENT) AS size,
                     coalesce(sum(p.ABSOLUTE_FREQUENCY), 0) AS dot_n, coalesce(sum(p.N_IDF), 0) AS dot_idf
              FROM test t LEFT JOIN valid_ingredients i ON t.RECIPE_ID = i.RECIPE_ID
                   LEFT JOIN ingredient_profile p
                     ON p.USER_ID = t.USER_ID AND p.ID_INGREDIENT = i.ID_INGREDIENT
              GROUP BY t.USER_ID, t.RECIPE_ID, t.RATING)
             LEFT JOIN user_norms USING (USER_ID)""",
    "raw_scores": """
        SELECT *, (ING_ABSOLUTE_SIMILARITY + NUTRITION_SIMILARITY) / 2 AS ABS_NUT_SIMILARITY,
               (IDF_SIMILARITY + NUTRITION_SIMILARITY) / 2 AS IDF_NUT_SIMILARITY
        FROM nutrition_scores JOIN ingredient_scores USING (USER_ID, RECIPE_ID, RATING)""",
    "similarities": f"""
        SELECT USER_ID, RECIPE_ID, RATING, {", ".join(SCORES)},
               {", ".join(f"{raw} * 5.0 AS {big}" for raw, (big, _) in SCORES.items())},
               {", ".join(f"{_rating(f'round({raw} * 5.0, 9)')} AS {small}" for raw, (_, small) in SCORES.items())}
        FROM raw_scores""",
    # propagation recommender
    "rated_split": f"""
        SELECT USER_ID, RECIPE_ID, RATING,
               CASE WHEN {_fraction("USER_ID", "RECIPE_ID")} < 0.7 THEN 'train' ELSE 'test' END AS SPLIT
        FROM reviews
        WHERE USER_ID IN (SELECT USER_ID FROM reviews GROUP BY USER_ID HAVING count(*) >= 10)""",
    "propagated": """
        SELECT USER_ID, ID_INGREDIENT, avg(RATING) AS INGR_RATING
        FROM rated_split JOIN ingredients USING (RECIPE_ID)
        WHERE SPLIT = 'train' GROUP BY USER_ID, ID_INGREDIENT""",
    "predictions": f"""
        SELECT *, {_rating("predicted_rating")} AS propR
        FROM (SELECT USER_ID, RECIPE_ID, RATING, round(avg(INGR_RATING), 10) AS predicted_rating
              FROM rated_split JOIN ingredients USING (RECIPE_ID)
                   JOIN propagated USING (USER_ID, ID_INGREDIENT)
              WHERE SPLIT = 'test' GROUP BY USER_ID, RECIPE_ID, RATING)""",
    "scored": """
        SELECT USER_ID, RECIPE_ID, RATING, 'predicted_rating' AS score, predicted_rating AS value FROM predictions
        UNION ALL
        SELECT USER_ID, RECIPE_ID, RATING, 'propR', CAST(propR AS DOUBLE) FROM predictions""",
    "scored_similarities": " UNION ALL ".join(
        f"SELECT USER_ID, RECIPE_ID, RATING, '{small}' AS score, CAST({small} AS DOUBLE) AS value FROM similarities"
        for _, small in SCORES.values()
    ),
    "raw_scored": " UNION ALL ".join(
        f"SELECT USER_ID, RECIPE_ID, RATING, '{raw}' AS score, {raw} AS value FROM similarities" for raw in SCORES
    ),
    # graph and text
    "edges": """
        SELECT a.ID_INGREDIENT AS ORIGIN, b.ID_INGREDIENT AS DESTINATION, count(*) AS N_RECIPES
        FROM baskets a JOIN baskets b
          ON a.ID_RECIPE = b.ID_RECIPE AND a.ID_INGREDIENT < b.ID_INGREDIENT
        GROUP BY a.ID_INGREDIENT, b.ID_INGREDIENT""",
    "n_baskets": "SELECT count(DISTINCT ID_RECIPE) AS n FROM baskets",
    "single": """
        SELECT ID_INGREDIENT, count(*) / (SELECT n FROM n_baskets) AS p FROM baskets GROUP BY ID_INGREDIENT""",
    "words": """
        SELECT ID_INGREDIENT, LINE_NO, list_filter(
                 string_split_regex(regexp_replace(TEXT_VALUE, '[,.:;()!/%0-9]', ' ', 'g'), '\\s+'),
                 lambda w: regexp_full_match(w, '[a-zA-Z-]+') AND length(w) > 2 AND w NOT IN (
                   'tablespoon', 'tablespoons', 'teaspoon', 'teaspoons', 'cup', 'cups', 'ounce', 'ounces',
                   'inch', 'inches')) AS ws
        FROM ingredient_text""",
    "tokens": """
        SELECT ID_INGREDIENT, LINE_NO, CAST(i - 1 AS INTEGER) AS position, ws[i] AS word
        FROM (SELECT *, unnest(generate_series(1, len(ws))) AS i FROM words)""",
    "numbered": """
        SELECT ID_INGREDIENT, LINE_NO, row_number() OVER (PARTITION BY ID_INGREDIENT ORDER BY LINE_NO) AS rn
        FROM ingredient_text""",
    "name_words": """
        SELECT ID_INGREDIENT, word, count(DISTINCT rn) AS n, min(position) FILTER (WHERE rn = 1) AS first
        FROM tokens JOIN numbered USING (ID_INGREDIENT, LINE_NO) GROUP BY ID_INGREDIENT, word""",
    "lemmas": """
        SELECT word, least(min(word[1:3]), min(word[1:4])) AS lemma
        FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY word""",
    "lemma_words": """
        SELECT ID_INGREDIENT, coalesce(lemma, word) AS name_word, count(DISTINCT rn) AS n,
               min(position) FILTER (WHERE rn = 1) AS first
        FROM tokens JOIN numbered USING (ID_INGREDIENT, LINE_NO) LEFT JOIN lemmas USING (word)
        GROUP BY ID_INGREDIENT, name_word""",
    "drawn": f"""
        SELECT *, {_fraction("ID", seed=42)} < 0.7 AS training FROM difficulty WHERE COOK_TIME > 0""",
    "label_order": """
        SELECT DIFFICULTY, row_number() OVER (ORDER BY count(*) DESC, DIFFICULTY) AS place
        FROM difficulty WHERE COOK_TIME > 0 GROUP BY DIFFICULTY""",
    "cuts": """
        SELECT (max(COOK_TIME) FILTER (DIFFICULTY = 'easy') + min(COOK_TIME) FILTER (DIFFICULTY = 'medium')) / 2 AS easy,
               (max(COOK_TIME) FILTER (DIFFICULTY = 'medium') + min(COOK_TIME) FILTER (DIFFICULTY = 'hard')) / 2 AS medium
        FROM drawn WHERE training""",
    "tree_predictions": """
        SELECT ID, DIFFICULTY,
               CASE WHEN COOK_TIME <= easy THEN 'easy' WHEN COOK_TIME <= medium THEN 'medium' ELSE 'hard' END AS predictedLabel
        FROM drawn CROSS JOIN cuts WHERE NOT training""",
    "bayes_counts": """
        SELECT DIFFICULTY AS label, count(*) AS n, sum(COOK_TIME) AS x1, sum(N_INGREDIENTS) AS x2, sum(N_STEPS) AS x3,
               x1 + x2 + x3 AS x
        FROM drawn WHERE training GROUP BY DIFFICULTY""",
    "bayes_predictions": """
        SELECT drawn.ID, drawn.DIFFICULTY, label AS predictedLabel
        FROM drawn CROSS JOIN bayes_counts JOIN label_order ON label_order.DIFFICULTY = label
        WHERE NOT training
        QUALIFY row_number() OVER (PARTITION BY ID ORDER BY
          ln(n + 1) + COOK_TIME * ln((x1 + 1) / (x + 3)) + N_INGREDIENTS * ln((x2 + 1) / (x + 3))
          + N_STEPS * ln((x3 + 1) / (x + 3)) DESC, place) = 1""",
}


def _compose(body: str) -> str:
    """Prefix ``body`` with the common table expressions it needs, in the order of ``CTES``."""
    needed: set[str] = set()

    def visit(sql: str) -> None:
        for name in re.findall(r"\b(?:FROM|JOIN)\s+([a-z_]+)", sql):
            if name in CTES and name not in needed:
                needed.add(name)
                visit(CTES[name])

    visit(body)
    parts = ",\n".join(f"{name} AS ({sql})" for name, sql in CTES.items() if name in needed)
    return f"WITH {parts}\n{body}" if parts else body


def _regression(table: str) -> str:
    return f"""
        SELECT score, round(avg((RATING - value) * (RATING - value)), 6) AS mse,
               round(avg(abs(RATING - value)), 6) AS mae,
               round(sqrt(avg((RATING - value) * (RATING - value))), 6) AS rmse
        FROM {table} GROUP BY score"""


def _counts(table: str, cut: float) -> str:
    hit = f"coalesce(value >= {cut}, false)"
    return f"""
        SELECT score, count(*) FILTER (WHERE {hit} AND RATING >= 3) AS tp,
               count(*) FILTER (WHERE NOT {hit} AND RATING < 3) AS tn,
               count(*) FILTER (WHERE {hit} AND RATING < 3) AS fp,
               count(*) FILTER (WHERE NOT {hit} AND RATING >= 3) AS fn
        FROM {table} GROUP BY score"""


def _confusion(table: str, cut: float = 3) -> str:
    return f"""
        SELECT score, tp, tn, fp, fn,
               round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy,
               round(tp / nullif(tp + fp, 0), 6) AS ppv, round(tn / nullif(tn + fn, 0), 6) AS npv,
               round(tp / nullif(tp + fn, 0), 6) AS tpr, round(tn / nullif(tn + fp, 0), 6) AS tnr,
               round(fp / nullif(fp + tn, 0), 6) AS fpr, round(fn / nullif(fn + tp, 0), 6) AS fnr,
               round((tp / nullif(tp + fn, 0)) / nullif(fp / nullif(fp + tn, 0), 0), 6) AS likelihood_ratio
        FROM ({_counts(table, cut)})"""


def _binary(table: str) -> str:
    return f"""
        SELECT score,
               round(CASE WHEN pos = 0 THEN 0.0 WHEN hit = 0 THEN base
                     ELSE r * p + (1 - r) * (p + base) / 2 END, 6) AS area_pr,
               round(CASE WHEN pos = 0 THEN 0.0 WHEN neg = 0 THEN 1.0 ELSE (r - f + 1) / 2 END, 6) AS area_roc,
               CASE WHEN hit > 0 THEN round(p, 6) END AS precision_1,
               CASE WHEN hit > 0 THEN round(r, 6) END AS recall_1,
               CASE WHEN hit > 0 THEN round(coalesce(2 * p * r / nullif(p + r, 0), 0.0), 6) END AS f1_1,
               CASE WHEN miss > 0 THEN round(base, 6) END AS precision_0,
               CASE WHEN miss > 0 THEN CAST(CASE WHEN pos = 0 THEN 0 ELSE 1 END AS DOUBLE) END AS recall_0,
               CASE WHEN miss > 0 THEN round(2 * base / (base + 1), 6) END AS f1_0
        FROM (SELECT score, tp + fn AS pos, fp + tn AS neg, tp + fp AS hit, fn + tn AS miss,
                     (tp + fn) / (tp + fn + fp + tn) AS base, coalesce(tp / nullif(tp + fp, 0), 0.0) AS p,
                     coalesce(tp / nullif(tp + fn, 0), 0.0) AS r, coalesce(fp / nullif(fp + tn, 0), 0.0) AS f
              FROM ({_counts(table, 3)}))"""


def _precision(table: str) -> str:
    per_user = ", ".join(f"count(*) FILTER (WHERE rn <= {k} AND RATING >= 3) / {k} AS p_at_{k}" for k in KS)
    mean = ", ".join(f"round(avg(p_at_{k}), 6) AS p_at_{k}" for k in KS)
    return f"""
        SELECT score, {mean}
        FROM (SELECT score, USER_ID, {per_user}
              FROM (SELECT *, row_number() OVER (PARTITION BY score, USER_ID
                                                 ORDER BY value DESC NULLS LAST, RECIPE_ID) AS rn
                    FROM {table})
              GROUP BY score, USER_ID)
        GROUP BY score"""


_RANKED = """
        SELECT USER_ID, RECIPE_ID,
               row_number() OVER (PARTITION BY USER_ID ORDER BY RATING DESC NULLS LAST, RECIPE_ID) AS r1,
               row_number() OVER (PARTITION BY USER_ID ORDER BY predicted_rating DESC NULLS LAST, RECIPE_ID) AS r2
        FROM predictions"""

_CORR = [("N_STEPS", "N_INGREDIENTS"), ("N_STEPS", "COOK_TIME"), ("COOK_TIME", "N_INGREDIENTS")]
_FEATURES = ("COOK_TIME", "N_INGREDIENTS", "N_STEPS")

BODIES: dict[str, str] = {
    "csv_roundtrip": "SELECT * FROM interactions",
    "parquet_roundtrip": "SELECT * FROM reviews",
    "typed_nutrition": """
        SELECT p_partkey AS RECIPE_ID, CAST(p_size AS DOUBLE) AS CALORIES, p_retailprice AS FAT,
               TRY_CAST(p_brand AS DOUBLE) AS PROTEIN FROM part""",
    "unify_interactions": "SELECT RECIPE_TYPE, RECIPE_ID, USER_ID FROM interactions",
    "drop_sentinel": "SELECT * FROM ingredients",
    "bad_id_audit": """
        SELECT count(*) FILTER (WHERE USER_ID IN (0, -1)) AS n_bad, count(*) AS n_rows FROM interactions""",
    "bucket_types": "SELECT * FROM bucketed",
    "dedupe_reviews": """
        SELECT USER_ID, RECIPE_ID, RATING, ID FROM interactions WHERE RECIPE_TYPE = 'review'
        QUALIFY row_number() OVER (PARTITION BY USER_ID, RECIPE_ID ORDER BY ID, RATING) = 1""",
    "valid_recipes": "SELECT RECIPE_ID FROM valid",
    "filter_dataset": """
        SELECT 'interactions' AS TABLE_NAME, RECIPE_ID, count(*) AS N FROM valid_bucketed GROUP BY RECIPE_ID
        UNION ALL
        SELECT 'nutrition', RECIPE_ID, count(*) FROM valid_nutrition GROUP BY RECIPE_ID""",
    "reviews_with_recipe": """
        SELECT ID, RECIPE_ID, USER_ID, RATING FROM interactions
        WHERE RECIPE_TYPE = 'review'
          AND RECIPE_ID IN (SELECT RECIPE_ID FROM interactions WHERE RECIPE_TYPE = 'recipes')""",
    "clean_authored": """
        SELECT DISTINCT ID_RECIPE, ID_USER AS ID_AUTHOR FROM user_roles WHERE ROLE = 'author' AND ID_USER <> 0""",
    "exclusive_interactions": """
        SELECT USER_ID, RECIPE_ID, ID, "type" FROM bucketed b
        WHERE NOT EXISTS (
          SELECT 1 FROM bucketed o JOIN bucketed r USING (USER_ID, RECIPE_ID)
          WHERE o."type" = 'recipes' AND r."type" = 'reviews'
            AND o.USER_ID = b.USER_ID AND o.RECIPE_ID = b.RECIPE_ID)""",
    "user_nutrition_rows": """
        SELECT * FROM (SELECT DISTINCT USER_ID, RECIPE_ID FROM interactions) JOIN nutrition USING (RECIPE_ID)""",
    "rated_split": "SELECT * FROM rated_split",
    "interactions_train": "SELECT RECIPE_ID, USER_ID FROM training",
    "ingredient_counts": "SELECT ID_INGREDIENT, count(*) AS N FROM ingredients GROUP BY ID_INGREDIENT",
    "user_stats": "SELECT * FROM stats",
    "pivot_sum": "SELECT USER_ID, "
    + ", ".join(
        f"CAST(coalesce(sum(RATING) FILTER (WHERE RECIPE_TYPE = '{t}'), 0) AS BIGINT) AS {t}"
        for t in ("fav", "madeit", "recipes", "review")
    )
    + " FROM interactions GROUP BY USER_ID",
    "nutrition_profile_sum": f"""
        SELECT USER_ID, {_each("sum({c}) AS {c}")}
        FROM training JOIN valid_nutrition USING (RECIPE_ID) GROUP BY USER_ID""",
    "nutrition_profile_avg": "SELECT * FROM nutrition_profile",
    "graph_counts": """
        SELECT count(DISTINCT ID_RECIPE) AS n_recipes, count(DISTINCT ID_INGREDIENT) AS n_ingredients FROM lines""",
    "activity_curve": """
        SELECT 'total_recipes' AS measure, CAST(t AS INTEGER) AS threshold,
               (SELECT count(*) FROM stats WHERE total_recipes >= t) AS n_users
        FROM range(30, 101) r(t)
        UNION ALL
        SELECT 'total_reviews', CAST(t AS INTEGER), (SELECT count(*) FROM stats WHERE total_reviews >= t)
        FROM range(10, 101) r(t)""",
    "difficulty_counts": """
        SELECT SOURCE, count(*) AS total, count(*) FILTER (WHERE DIFFICULTY = 'hard') AS hard,
               count(*) FILTER (WHERE DIFFICULTY = 'medium') AS medium,
               count(*) FILTER (WHERE DIFFICULTY = 'easy') AS easy
        FROM difficulty GROUP BY SOURCE""",
    "author_activity": """
        SELECT *, count(*) OVER (PARTITION BY ID_USER) AS RECIPE_COUNT
        FROM (SELECT DISTINCT * FROM user_roles WHERE ROLE = 'author' AND ID_USER <> 0)""",
    "reviewer_activity": """
        SELECT *, count(*) OVER (PARTITION BY ID_USER) AS RECIPE_COUNT
        FROM user_roles WHERE ROLE = 'reviewer' AND ID_USER <> 0""",
    "author_totals": """
        SELECT ID_USER, ROLE, count(DISTINCT ID_RECIPE) AS RECIPE_COUNT
        FROM user_roles WHERE ROLE = 'author' AND ID_USER <> 0 GROUP BY ID_USER, ROLE""",
    "reviewer_totals": """
        SELECT ID_USER, ROLE, count(*) AS RECIPE_COUNT
        FROM user_roles WHERE ROLE = 'reviewer' AND ID_USER <> 0 GROUP BY ID_USER, ROLE""",
    "active_users": """
        SELECT USER_ID, total_recipes AS n_recipes, total_reviews AS n_reviews
        FROM stats WHERE total_recipes > 10 AND total_reviews > 10""",
    "difficulty_corr": "SELECT "
    + ", ".join(f"round(corr({a}, {b}), 6) AS corr_{a}_{b}" for a, b in _CORR)
    + " FROM difficulty",
    "difficulty_cov": "SELECT "
    + ", ".join(f"round(covar_samp({a}, {b}), 6) AS cov_{a}_{b}" for a, b in _CORR)
    + " FROM difficulty",
    "corr_matrix": " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM difficulty"
        for a in _FEATURES
        for b in _FEATURES
    ),
    "test_split": """
        SELECT USER_ID, RECIPE_ID, RATING FROM rated_split
        WHERE SPLIT = 'test' AND USER_ID IN (SELECT USER_ID FROM rated_split WHERE SPLIT = 'train')""",
    "ingredient_idf": "SELECT * FROM idf",
    "ingredient_profile": "SELECT * FROM ingredient_profile",
    "ingredient_profile_rel": """
        SELECT p.*, round(ABSOLUTE_FREQUENCY / n, 6) AS RELATIVE_FREQUENCY
        FROM ingredient_profile p
             JOIN (SELECT USER_ID, count(*) AS n FROM training GROUP BY USER_ID) USING (USER_ID)""",
    "nutrition_similarity": """
        SELECT USER_ID, RECIPE_ID, RATING, round(NUTRITION_SIMILARITY, 6) AS NUTRITION_SIMILARITY
        FROM nutrition_scores""",
    "ingredient_similarity": """
        SELECT USER_ID, RECIPE_ID, RATING, round(ING_ABSOLUTE_SIMILARITY, 6) AS ING_ABSOLUTE_SIMILARITY,
               round(IDF_SIMILARITY, 6) AS IDF_SIMILARITY
        FROM ingredient_scores""",
    "similarity_table": f"""
        SELECT USER_ID, RECIPE_ID, RATING, {_each("round({c}, 6) AS {c}", SCORES)},
               {_each("round({c}, 6) AS {c}", [b for b, _ in SCORES.values()])},
               {", ".join(s for _, s in SCORES.values())}
        FROM similarities""",
    "scaled_similarity": f"""
        SELECT USER_ID, RECIPE_ID, RATING, {", ".join(b for b, _ in SCORES.values())},
               {", ".join(f"{_rating(b)} AS {s}" for b, s in SCORES.values())}
        FROM (SELECT USER_ID, RECIPE_ID, RATING,
                     {", ".join(f"{_decimal_round(f'{raw} * 5.0', 4)} AS {b}" for raw, (b, _) in SCORES.items())}
              FROM raw_scores)""",
    "rating_rounding": f"""
        SELECT round(score, 6) AS score, count(*) AS n, {_rating("score")} AS rating,
               CAST(floor(score + 0.5) AS INTEGER) AS nearest
        FROM (SELECT l_quantity / 10 - 1 AS score FROM lineitem) GROUP BY score""",
    "column_min": """
        SELECT p_partkey, CASE WHEN a <= b THEN a ELSE b END AS smaller
        FROM (SELECT p_partkey, CASE WHEN p_size > 1 THEN p_size END AS a,
                     CASE WHEN p_size < 50 THEN CAST(floor(p_retailprice / 100) AS INTEGER) END AS b
              FROM part)""",
    "top_n_ingredients": """
        SELECT * FROM baskets WHERE ID_INGREDIENT IN (
          SELECT ID_INGREDIENT FROM baskets GROUP BY ID_INGREDIENT ORDER BY count(*) DESC, ID_INGREDIENT LIMIT 50)""",
    "cooccurrence_pairs": """
        SELECT ORIGIN, DESTINATION, N_RECIPES FROM edges
        UNION ALL SELECT DESTINATION, ORIGIN, N_RECIPES FROM edges""",
    "ingredient_graph": "SELECT ORIGIN, DESTINATION FROM edges",
    "ingredient_graph_blocked": """
        SELECT a.ID_INGREDIENT AS ORIGIN, b.ID_INGREDIENT AS DESTINATION, count(*) AS N_RECIPES
        FROM baskets a JOIN baskets b ON a.ID_RECIPE = b.ID_RECIPE AND a.ID_INGREDIENT < b.ID_INGREDIENT
        GROUP BY a.ID_INGREDIENT, b.ID_INGREDIENT""",
    "pair_probability": """
        SELECT ORIGIN, DESTINATION, round(N_RECIPES / n, 9) AS "P(ORIGIN,DESTINATION)"
        FROM edges CROSS JOIN n_baskets""",
    "ingredient_pmi": """
        SELECT ORIGIN, DESTINATION, round(p, 6) AS "P(ORIGIN,DESTINATION)",
               round(1 / p, 6) AS "1/P(ORIGIN,DESTINATION)", round(log2(p / (po * pd)), 6) AS PMI
        FROM (SELECT ORIGIN, DESTINATION, N_RECIPES / n AS p, o.p AS po, d.p AS pd
              FROM edges CROSS JOIN n_baskets
                   JOIN single o ON o.ID_INGREDIENT = ORIGIN JOIN single d ON d.ID_INGREDIENT = DESTINATION)""",
    "ingredient_tokens": "SELECT ID_INGREDIENT, LINE_NO, position, word FROM tokens",
    "ingredient_names": """
        SELECT ID_INGREDIENT,
               coalesce(string_agg(word, ' ' ORDER BY coalesce(first, 0), word)
                        FILTER (WHERE first IS NOT NULL OR n >= n_lines // 2), '') AS NAME
        FROM (SELECT ID_INGREDIENT, max(rn) AS n_lines FROM numbered GROUP BY ID_INGREDIENT)
             LEFT JOIN name_words USING (ID_INGREDIENT)
        GROUP BY ID_INGREDIENT""",
    "type_split": """
        SELECT USER_ID, RECIPE_ID, "type",
               CASE WHEN "type" = 'recipes' THEN 'train' ELSE 'test' END AS SPLIT
        FROM bucketed
        WHERE USER_ID IN (SELECT USER_ID FROM stats WHERE total_reviews >= 10 AND total_recipes >= 30)""",
    "recipe_id_split": """
        SELECT DISTINCT CASE WHEN "type" = 'recipes' THEN 'train' ELSE 'test' END AS SPLIT, RECIPE_ID
        FROM bucketed""",
    "propagated_ratings": "SELECT USER_ID, ID_INGREDIENT, round(INGR_RATING, 6) AS INGR_RATING FROM propagated",
    "propagation_predict": """
        SELECT USER_ID, RECIPE_ID, RATING, round(predicted_rating, 6) AS predicted_rating, propR
        FROM predictions""",
    "percent_split": f"""
        SELECT USER_ID, RECIPE_ID,
               CASE WHEN {_fraction("USER_ID", "RECIPE_ID")} < 0.7 THEN 'train' ELSE 'test' END AS SPLIT
        FROM reviews
        WHERE USER_ID IN (SELECT USER_ID FROM reviews GROUP BY USER_ID HAVING count(*) >= 10)""",
    "test_subset": f"""
        SELECT USER_ID, RECIPE_ID, RATING FROM rated_split
        WHERE SPLIT = 'test' AND {_fraction("USER_ID", "RECIPE_ID", seed=1)} < 0.25""",
    "training_ingredients": """
        SELECT RECIPE_ID, ID_INGREDIENT FROM valid_ingredients
        WHERE RECIPE_ID IN (SELECT RECIPE_ID FROM training)""",
    "regression_metrics": _regression("scored"),
    "binary_metrics": _binary("scored"),
    "confusion_metrics": _confusion("scored"),
    "precision_at_k": _precision("scored"),
    "prefix_agreement": "SELECT USER_ID, "
    + ", ".join(f"round(least(m, {k}) / {k}, 6) AS agreement_at_{k}" for k in range(1, 6))
    + f"""
        FROM (SELECT USER_ID, coalesce(min(a.r1) FILTER (WHERE a.RECIPE_ID <> b.RECIPE_ID) - 1, max(a.r1)) AS m
              FROM ({_RANKED}) a JOIN ({_RANKED}) b USING (USER_ID)
              WHERE a.r1 = b.r2 AND a.r1 <= 5 GROUP BY USER_ID)""",
    "topk_overlap": "SELECT "
    + ", ".join(f"round(avg(o{k}), 6) AS overlap_at_{k}" for k in KS)
    + " FROM (SELECT USER_ID, "
    + ", ".join(f"count(*) FILTER (WHERE r1 <= {k} AND r2 <= {k}) / {k} AS o{k}" for k in KS)
    + f" FROM ({_RANKED}) GROUP BY USER_ID)",
    "evaluation_report": f"""
        SELECT * FROM ({_regression("scored_similarities")})
        JOIN ({_binary("scored_similarities")}) USING (score)
        JOIN ({_confusion("scored_similarities")}) USING (score)
        JOIN ({_precision("scored_similarities")}) USING (score)""",
    "propagation_report": f"""
        SELECT * FROM ({_regression("scored")}) JOIN ({_binary("scored")}) USING (score)
        JOIN ({_confusion("scored")}) USING (score) JOIN ({_precision("scored")}) USING (score)
        WHERE score = 'propR'""",
    "raw_score_report": _confusion("raw_scored", 0.5),
    "top_k_beyond_limit": """
        SELECT l_returnflag, l_orderkey, l_linenumber, l_extendedprice,
               CAST(row_number() OVER (PARTITION BY l_returnflag
                                       ORDER BY l_extendedprice DESC NULLS LAST, l_orderkey, l_linenumber) AS INTEGER) AS rank
        FROM lineitem QUALIFY rank <= 5000""",
    "difficulty_dataset": """
        SELECT ID, COOK_TIME, N_INGREDIENTS, N_STEPS, DIFFICULTY FROM difficulty WHERE COOK_TIME > 0""",
    "label_index": """
        SELECT DIFFICULTY, CAST(row_number() OVER (ORDER BY count(*) DESC, DIFFICULTY) - 1 AS DOUBLE) AS indexedLabel,
               count(*) AS n
        FROM difficulty WHERE COOK_TIME > 0 GROUP BY DIFFICULTY""",
}

_QUOTA = f"""
        SELECT USER_ID, total_recipes, total_reviews, recipes, reviews,
               {_decimal_round("recipes / nullif(total_recipes, 0)", 3)} AS ratio_recipes,
               {_decimal_round("reviews / nullif(total_reviews, 0)", 3)} AS ratio_reviews
        FROM (SELECT *, CAST(floor(0.7 * total_recipes) AS INTEGER) AS recipes,
                     CAST(floor(least(0.3 * total_recipes, total_reviews)) AS INTEGER) AS reviews
              FROM stats WHERE total_reviews >= 10 AND total_recipes >= 10)"""
BODIES["user_quota"] = _QUOTA
BODIES["quota_split"] = f"""
        SELECT b.USER_ID, RECIPE_ID, ID, "type",
               CASE WHEN "type" = 'recipes' THEN 'train' ELSE 'test' END AS SPLIT
        FROM bucketed b JOIN ({_QUOTA}) q ON b.USER_ID = q.USER_ID
        WHERE {_fraction("b.USER_ID", "RECIPE_ID", '"type"')}
              < CASE WHEN "type" = 'recipes' THEN ratio_recipes ELSE ratio_reviews END"""

BODIES["lemma_names"] = (
    BODIES["ingredient_names"].replace("name_words", "lemma_words").replace("string_agg(word", "string_agg(name_word").replace("first, 0), word", "first, 0), name_word")
)
BODIES["graph_table"] = BODIES["ingredient_graph"]
BODIES |= {
    "difficulty_tree": "SELECT ID, DIFFICULTY, predictedLabel FROM tree_predictions",
    "difficulty_bayes": "SELECT ID, DIFFICULTY, predictedLabel FROM bayes_predictions",
    "difficulty_accuracy": """
        SELECT 'tree' AS model, round(avg((DIFFICULTY = predictedLabel)::DOUBLE), 6) AS accuracy, count(*) AS n FROM tree_predictions
        UNION ALL
        SELECT 'bayes', round(avg((DIFFICULTY = predictedLabel)::DOUBLE), 6), count(*) FROM bayes_predictions""",
    "category_tree": f"""
        SELECT ID, REGION_GROUP, REGION_GROUP AS predictedLabel
        FROM (SELECT o_orderkey AS ID, CASE WHEN n_regionkey IN (0, 2, 3) THEN 'inner' ELSE 'outer' END AS REGION_GROUP
              FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
        WHERE NOT {_fraction("ID", seed=42)} < 0.7""",
    "pca": """
        SELECT 'norm' AS what, vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 6) AS value
        FROM embeddings
        UNION ALL
        SELECT 'covariance ' || i || ',' || j, NULL, 0.0 FROM range(1, 6) a(i), range(1, 6) b(j) WHERE i < j
        UNION ALL
        SELECT 'falling ' || i, NULL, 1.0 FROM range(1, 5) a(i)""",
    "transcoded_lines": r"""
        SELECT line, count(*) AS n
        FROM (SELECT unnest(string_split(replace(text, chr(13), ' '), chr(10))) AS line FROM documents WHERE text IS NOT NULL)
        GROUP BY line""",
    "libsvm_round_trip": """
        SELECT vec_id, len(list_filter(v, lambda x: x <> 0))::INTEGER AS n_nonzero, round(v[1], 6) AS x1,
               round(greatest(0, list_max(v)), 6) AS largest
        FROM (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN abs(x::DOUBLE) < 0.05 THEN 0 ELSE x::DOUBLE END) AS v
              FROM embeddings)""",
    "unquoted_documents": r"""
        SELECT doc_id, length(value) AS n_chars, md5(value) AS digest
        FROM (SELECT doc_id, '"' || regexp_replace(coalesce(text, ''), '[\r\n|]', ' ', 'g') || '" x' AS value FROM documents)""",
    "recipe_ids": "SELECT p_partkey AS RECIPE_ID, p_name, p_size FROM part",
}


def _shown(column: str) -> str:
    return f"CAST(CAST(CAST({column} AS DECIMAL(28,6)) AS DECIMAL(28,3)) AS VARCHAR)"


_COUNTS = ("tp", "tn", "fp", "fn")
_MEASURES = (
    "mse", "mae", "rmse", "area_pr", "area_roc", "precision_1", "recall_1", "f1_1", "precision_0", "recall_0", "f1_0",
    "accuracy", "ppv", "npv", "tpr", "tnr", "fpr", "fnr", "p_at_5", "p_at_10", "p_at_30",
)
BODIES["report_text"] = (
    f"SELECT score, CASE WHEN fpr = 0 THEN 'MAX' ELSE {_shown('likelihood_ratio')} END AS likelihood_ratio, "
    + ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in _COUNTS)
    + ", "
    + ", ".join(f"{_shown(c)} AS {c}" for c in _MEASURES)
    + f" FROM ({BODIES['evaluation_report']})"
)


def oracles() -> dict[str, str]:
    """Complete statements by query name."""
    return {name: _compose(body) for name, body in BODIES.items()}
