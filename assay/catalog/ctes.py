"""The same study in DuckDB SQL, written independently as one common table per step."""

from __future__ import annotations

import re

from ..functions.families import DUAL_USE_WORDS, GENERIC_WORDS, PUP_WORDS

SEED = 20260922


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def clean_sql(column: str) -> str:
    return f"coalesce(lower(regexp_replace(regexp_replace({column}, '^\\s+', ''), '\\s+$', '')), '')"


def class_sql(column: str) -> str:
    tokens = f"regexp_extract_all(lower({column}), '[a-z0-9]+')"
    return f"""CASE WHEN {clean_sql(column)} = '' THEN 'none'
        WHEN list_has_any({tokens}, {_list(PUP_WORDS)}) THEN 'pup'
        WHEN list_has_any({tokens}, {_list(DUAL_USE_WORDS)}) THEN 'dual_use'
        WHEN len(list_filter({tokens}, lambda t: length(t) >= 4 AND regexp_full_match(t, '[a-z]+')
             AND NOT list_contains({_list(GENERIC_WORDS)}, t))) > 0 THEN 'specific'
        ELSE 'generic' END"""


def band_sql(mal: str, n: str, floor: str = "2") -> str:
    m = f"({mal})::DOUBLE / nullif({n}, 0)"
    return f"""CASE WHEN {n} < greatest({floor}, 1) THEN 'below_floor' WHEN {m} = 0 THEN 'consensus_clean'
        WHEN {m} <= 0.25 THEN 'leaning_clean' WHEN {m} < 0.6 THEN 'contested'
        WHEN {m} < 0.75 THEN 'leaning_malicious' ELSE 'consensus_malicious' END"""


def logit_sql(p: str) -> str:
    kept = f"least(greatest({p}, 1e-6), 1 - 1e-6)"
    return f"ln({kept} / (1 - {kept}))"


CTES: dict[str, str] = {
    "scans": """SELECT o_orderkey AS number, sha256(CAST(o_custkey AS varchar)) AS sha256, o_orderdate AS completed,
        CASE o_orderpriority WHEN '5-LOW' THEN 'feed' WHEN '4-NOT SPECIFIED' THEN NULL ELSE 'default' END AS scan_config,
        o_totalprice / 500000 AS incumbent_score, o_orderstatus AS state FROM orders""",
    "instances": """SELECT number, sha256, completed AS created,
        CASE WHEN number % 23 <> 0 THEN completed + to_seconds(number % 600) END AS completed,
        CASE WHEN number % 29 = 0 THEN true WHEN number % 29 = 1 THEN NULL ELSE false END AS failed,
        CASE WHEN state = 'P' AND number % 13 = 0 THEN 'KNOWN_GOOD' ELSE state END AS state,
        CASE WHEN number % 17 = 0 THEN 'URL' ELSE 'FILE' END AS artifact_type,
        CASE WHEN number % 11 = 0 THEN '_private' WHEN number % 11 <> 1 THEN '_public' END AS meta_community,
        CASE number % 4 WHEN 0 THEN 'application/x-dosexec' WHEN 1 THEN 'application/vnd.microsoft.portable-executable'
             WHEN 2 THEN 'application/x-msdownload' ELSE 'text/html' END AS mimetype,
        CASE WHEN number % 7 = 0 THEN 'PE32+ executable' WHEN number % 7 <> 1 THEN 'PE32 executable' END AS extended_type,
        CASE number % 5 WHEN 0 THEN '{"scan":"false"}' WHEN 1 THEN '{"_default":"false"}' WHEN 2 THEN '{"_default":"true"}'
             WHEN 4 THEN '{"scan":true,"_default":"false"}' END AS actions,
        scan_config, incumbent_score FROM scans""",
    "verdicts": """SELECT l_orderkey AS instance_number,
        concat('eng_', lpad(CAST(l_suppkey % 16 AS varchar), 2, '0')) AS author,
        CASE WHEN bool_or(l_returnflag = 'R') THEN true WHEN bool_or(l_returnflag = 'A') THEN false END AS verdict,
        CAST(max(l_quantity) AS BIGINT) AS bid,
        max(CASE l_partkey % 10 WHEN 2 THEN 'Trojan.Generic' WHEN 3 THEN 'Artemis!A1B2C3'
            WHEN 4 THEN concat('PUA.Adware.', p_name) WHEN 5 THEN concat('HackTool.', p_name)
            WHEN 6 THEN concat('Trojan.', p_name) WHEN 7 THEN concat('Win32.', p_name)
            WHEN 8 THEN 'Gen:Variant' END) AS malware_family
        FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2""",
    "counts": """SELECT instance_number, count(verdict) AS n_definite, count(*) FILTER (WHERE verdict) AS n_malicious,
        count(*) AS n_responded FROM verdicts GROUP BY 1""",
    "scored": """SELECT s.*, c.n_definite, c.n_malicious, c.n_responded FROM scans s JOIN counts c ON c.instance_number = s.number""",
    "frame": """SELECT sha256, number AS instance_number, completed AS scoring_moment, scan_config,
        incumbent_score AS incumbent_score, n_definite, n_malicious, n_responded
        FROM (SELECT *, row_number() OVER (PARTITION BY sha256 ORDER BY completed, number) AS rn FROM scored) WHERE rn = 1""",
    "nearest": """SELECT sha256, label_instance_number, label_moment, gap_days, l_definite, l_malicious, l_responded FROM (
        SELECT f.sha256, s.number AS label_instance_number, s.completed AS label_moment,
          date_diff('microsecond', f.scoring_moment, s.completed) / 86400000000.0 AS gap_days,
          s.n_definite AS l_definite, s.n_malicious AS l_malicious, s.n_responded AS l_responded,
          row_number() OVER (PARTITION BY f.sha256 ORDER BY s.completed, s.number) AS rn
        FROM frame f JOIN scored s ON s.sha256 = f.sha256 AND s.completed >= f.scoring_moment + INTERVAL 30 DAY
          AND s.completed < f.scoring_moment + INTERVAL 365 DAY) WHERE rn = 1""",
    "labelled": """SELECT f.*, n.* EXCLUDE (sha256), CASE WHEN f.scan_config = 'feed' THEN 'feed' ELSE 'customer' END AS provenance
        FROM frame f LEFT JOIN nearest n ON n.sha256 = f.sha256""",
    "base": "SELECT * FROM labelled WHERE label_instance_number IS NOT NULL",
    "unlabellable": "SELECT * FROM labelled WHERE label_instance_number IS NULL",
    "roles": """SELECT sha256, 'feature' AS scan_role, instance_number FROM base
        UNION ALL SELECT sha256, 'label', label_instance_number FROM base""",
    "long": """SELECT r.sha256, r.scan_role, v.* FROM verdicts v JOIN roles r ON r.instance_number = v.instance_number""",
    "banded": f"SELECT *, {band_sql('n_malicious', 'n_definite')} AS stratum FROM base",
    "targets": """SELECT * FROM (VALUES ('contested', 0.45::DOUBLE, 225::BIGINT), ('leaning_malicious', 0.15, 75),
        ('leaning_clean', 0.15, 75), ('consensus_malicious', 0.10, 50), ('consensus_clean', 0.10, 50),
        ('below_floor', 0.0, 0)) t(stratum, target_share, n_target)""",
    "report": """SELECT t.stratum, coalesce(a.n, 0) AS n_available, t.target_share, t.n_target,
        least(coalesce(a.n, 0), t.n_target) AS n_draw,
        CASE WHEN t.stratum <> 'below_floor' THEN least(a.n, t.n_target)::DOUBLE / nullif(a.n, 0) END AS pi,
        least(coalesce(a.n, 0), t.n_target) < t.n_target AS underfilled
        FROM targets t LEFT JOIN (SELECT stratum, count(*) AS n FROM banded GROUP BY 1) a USING (stratum)""",
    "cohort": f"""SELECT b.*, r.pi, r.n_available, r.n_draw FROM (
        SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5(sha256 || '{SEED}'), sha256) AS rn FROM banded) b
        JOIN report r ON r.stratum = b.stratum WHERE b.rn <= r.n_draw""",
    "at_t": "SELECT sha256, author, verdict FROM long WHERE scan_role = 'feature'",
    "at_l": "SELECT sha256, author, verdict, malware_family FROM long WHERE scan_role = 'label'",
    "paired": """SELECT coalesce(t.sha256, l.sha256) AS sha256, coalesce(t.author, l.author) AS author,
        t.sha256 IS NOT NULL AS in_t, l.sha256 IS NOT NULL AS in_l, t.verdict AS tv, l.verdict AS lv, l.malware_family
        FROM at_t t FULL OUTER JOIN at_l l ON t.sha256 = l.sha256 AND t.author = l.author""",
    "changes": """SELECT sha256, count(*) FILTER (WHERE in_t AND in_l AND tv IS DISTINCT FROM lv) AS flips,
        count(*) FILTER (WHERE tv AND NOT lv) AS retractions, count(*) FILTER (WHERE NOT in_t) AS joined,
        count(*) FILTER (WHERE NOT in_l) AS "left", count(*) FILTER (WHERE in_t AND in_l AND tv IS NOT DISTINCT FROM lv) AS stable
        FROM paired GROUP BY 1""",
    "classed": f"""SELECT sha256, verdict, {class_sql('malware_family')} AS class FROM at_l""",
    "evidence": """SELECT sha256, count(*) AS l_responded, count(verdict) AS n_definite, count(*) FILTER (WHERE verdict) AS n_malicious,
        coalesce(sum(CASE WHEN class IN ('specific', 'pup', 'dual_use') THEN 1.0::DOUBLE ELSE 0.5 END) FILTER (WHERE verdict), 0) AS weighted_malicious,
        count(*) FILTER (WHERE verdict AND class = 'specific') AS n_specific,
        count(*) FILTER (WHERE verdict AND class IN ('generic', 'none')) AS n_generic,
        count(*) FILTER (WHERE verdict AND class = 'pup') AS n_pup,
        count(*) FILTER (WHERE verdict AND class = 'dual_use') AS n_dual_use FROM classed GROUP BY 1""",
    "labels_out": """SELECT c.sha256, e.* EXCLUDE (sha256), g.flips, g.retractions, g.joined, g."left", g.stable,
        c.stratum, c.pi, c.provenance, c.scoring_moment, c.gap_days AS horizon_days, 1 AS grade,
        CASE WHEN e.sha256 IS NULL THEN 'undecidable' WHEN e.n_definite < 2 THEN 'undecidable' WHEN e.n_malicious = 0 THEN 'benign'
          WHEN e.weighted_malicious >= 1.0 THEN CASE WHEN e.n_pup >= 2 AND e.n_pup >= e.n_specific THEN 'unwanted'
            WHEN e.n_dual_use >= 2 AND e.n_dual_use >= e.n_specific THEN 'unwanted' ELSE 'malicious' END
          ELSE 'undecidable' END AS label,
        CASE WHEN e.sha256 IS NULL THEN 'no_label_scan_assertions' WHEN e.n_definite < 2 THEN 'below_floor'
          WHEN e.n_malicious = 0 THEN CASE WHEN g.retractions > 0 THEN 'retracted' ELSE 'no_detection' END
          WHEN e.weighted_malicious >= 1.0 THEN CASE WHEN e.n_pup >= 2 AND e.n_pup >= e.n_specific THEN 'pup_family'
            WHEN e.n_dual_use >= 2 AND e.n_dual_use >= e.n_specific THEN 'dual_use'
            WHEN e.n_specific >= 2 THEN 'specific_families' ELSE 'generic_volume' END
          ELSE 'weak_consensus' END AS reason
        FROM cohort c LEFT JOIN evidence e ON e.sha256 = c.sha256 LEFT JOIN changes g ON g.sha256 = c.sha256""",
    "labelled_cohort": """SELECT *, label IN ('malicious', 'benign') AS trainable, (label = 'malicious')::INT AS y FROM labels_out""",
    "fam_t": f"""SELECT sha256, {clean_sql('malware_family')} AS fam, {class_sql('malware_family')} AS class
        FROM long WHERE scan_role = 'feature' AND verdict""",
    "modal_t": """SELECT sha256, fam AS modal_family, n FROM (SELECT sha256, fam, count(*) AS n,
        row_number() OVER (PARTITION BY sha256 ORDER BY count(*) DESC, fam) AS rn FROM fam_t WHERE fam <> '' GROUP BY 1, 2) WHERE rn = 1""",
    "families": """SELECT f.sha256, count(*) FILTER (WHERE fam <> '') AS n_with_family,
        count(DISTINCT fam) FILTER (WHERE fam <> '') AS n_distinct_families, count(*) FILTER (WHERE class = 'specific') AS n_specific,
        count(*) FILTER (WHERE class IN ('generic', 'none')) AS n_generic, count(*) FILTER (WHERE class = 'pup') AS n_pup,
        count(*) FILTER (WHERE class = 'dual_use') AS n_dual_use,
        coalesce(max(m.n), 0)::DOUBLE / count(*) AS modal_family_share, coalesce(max(m.modal_family), '') AS modal_family
        FROM fam_t f LEFT JOIN modal_t m ON m.sha256 = f.sha256 GROUP BY 1""",
    "aggs": """SELECT sha256, count(*) AS n_responded, count(verdict) AS n_definite, count(*) FILTER (WHERE verdict) AS n_malicious,
        count(*) FILTER (WHERE NOT verdict) AS n_benign, count(*) - count(verdict) AS n_unknown,
        (count(*) FILTER (WHERE verdict))::DOUBLE / nullif(count(verdict), 0) AS m, (count(verdict) > 0)::INT AS m_defined,
        (count(*) FILTER (WHERE verdict))::DOUBLE / count(*) AS malicious_share_responded,
        avg(bid) FILTER (WHERE verdict) AS bid_mean_malicious, avg(bid) FILTER (WHERE NOT verdict) AS bid_mean_benign
        FROM long WHERE scan_role = 'feature' GROUP BY 1""",
    "split_input": """SELECT l.*, c.incumbent_score, c.n_malicious AS t_malicious, c.n_definite AS t_definite, f.modal_family,
        coalesce(nullif(f.modal_family, ''), l.sha256) AS "group"
        FROM labelled_cohort l JOIN cohort c ON c.sha256 = l.sha256 LEFT JOIN families f ON f.sha256 = l.sha256""",
    "groups_": """SELECT "group", min(scoring_moment) AS first, count(*) AS size FROM split_input WHERE trainable GROUP BY 1""",
    "group_share": """SELECT "group", sum(size) OVER (ORDER BY first, md5("group"), "group" ROWS UNBOUNDED PRECEDING)::DOUBLE
        / sum(size) OVER () AS share FROM groups_""",
    "folded": """SELECT s.*, CASE WHEN share > 0.60::DOUBLE + 0.15::DOUBLE THEN 'test' WHEN share > 0.60::DOUBLE THEN 'validate' ELSE 'train' END AS fold
        FROM split_input s JOIN group_share g ON g."group" = s."group" WHERE trainable""",
    "split_": """SELECT *, fold = 'test' AND scoring_moment < (SELECT max(scoring_moment) FROM folded WHERE fold = 'train')
        + INTERVAL 30 DAY AS in_gap FROM folded""",
    "quality_": """SELECT l.doc_id AS key, quality AS y, n_chars::DOUBLE AS score, n_chars / (n_chars + 1000.0::DOUBLE) AS prob, lang AS stratum,
        CASE WHEN source IN ('src0', 'src1', 'src2', 'src3') THEN 'feed' ELSE 'customer' END AS provenance,
        CASE lang WHEN 'en' THEN 0.5::DOUBLE WHEN 'fr' THEN 0.25 ELSE 0.125 END AS pi, toxic
        FROM labels l JOIN documents d ON d.doc_id = l.doc_id""",
}


def oracle(body: str, **extra: str) -> str:
    """`body` behind the common tables it needs, in order."""
    known = {**CTES, **extra}
    needed: set[str] = set()
    todo = [body]
    while todo:
        text = todo.pop()
        for name, sql in known.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                todo.append(sql)
    listed = ",\n".join(f"{n} AS ({known[n]})" for n in known if n in needed)
    return f"WITH RECURSIVE {listed}\n{body}" if listed else body
