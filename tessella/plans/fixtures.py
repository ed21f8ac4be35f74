"""Small inline tables, as SQL that Spark and DuckDB both read."""

ROBOTS = r"""SELECT * FROM (VALUES
 ('a', 'User-agent: *' || chr(10) || 'Disallow: /' || chr(10) || 'Sitemap: https://a.test/s.xml'),
 ('b', 'User-agent: GPTBot' || chr(10) || 'User-agent: CCBot' || chr(10) || 'Disallow: /' || chr(10) || 'User-agent: *' || chr(10) || 'Disallow: /x'),
 ('c', 'User-agent: gptbot # note' || chr(10) || chr(10) || 'User-agent: ClaudeBot' || chr(10) || 'Disallow: /'),
 ('d', 'User-agent: *' || chr(10) || 'Disallow: /' || chr(10) || 'Allow: /'),
 ('e', 'Disallow: /'),
 ('f', 'User-agent: GPTBot' || chr(10) || 'Disallow:' || chr(10) || 'User-agent: GPTBot' || chr(10) || 'Disallow: /')
) AS t(site, raw)"""

HREFLANG = r"""SELECT * FROM (VALUES
 ('https://a.test/en', 0, 'en', 'https://a.test/en'), ('https://a.test/en', 1, 'de', 'https://a.test/de'),
 ('https://a.test/en', 2, 'x-default', 'https://a.test/en'), ('https://a.test/en', 3, 'DE', '/de2'),
 ('https://a.test/de', 0, 'de', 'https://a.test/de'), ('https://a.test/de', 1, 'en-UK1', 'https://a.test/en'),
 ('https://a.test/fr', 0, 'fr-FR-x', 'https://a.test/fr'), ('https://a.test/fr', 1, 'qq', ''),
 ('https://a.test/fr', 2, 'en-GB', 'https://a.test/en')
) AS t(page, pos, hreflang, href)"""

JSONLD = r"""SELECT * FROM (VALUES
 (1, '{"@context":"https://schema.org","@type":"Article","headline":"H","author":"A","datePublished":"2024-01-01"}'),
 (2, '{"@context":"https://schema.org","@type":"Article","headline":""}'),
 (3, '{"@type":"Event","name":"N","startDate":"2024","location":[]}'),
 (4, '{"@context":"https://schema.org","@type":"Person","name":0}'),
 (5, '{"@context":"https://schema.org","@type":"Product","name":"P","image":{}}')
) AS t(id, json)"""

IDS = r"""SELECT * FROM (VALUES
 ('p1', '{"@id":"#org","name":"O"}'), ('p1', '{"@type":"Article","publisher":{"@id":"#org"},"author":{"@id":"#me"}}'),
 ('p2', '{"@type":"Article","publisher":{"@id":"#org"}}'), ('p3', '{"@type":"Article","author":{"@id":"#you"}}')
) AS t(url, json)"""

HTML = r"""SELECT * FROM (VALUES
 ('https://x.test/1', '<html lang="en"><head><title>Short</title><meta name="description" content="Too short"><meta name="robots" content="NOINDEX, follow"><link rel="canonical" href="https://x.test/1"><meta name="viewport" content="w"></head><body><h1>A</h1><h1>B</h1><img src="a.png"><img src="b.webp" alt="" width="1" height="2" loading="lazy"><script src="http://cdn.test/x.js"></script></body></html>'),
 ('http://x.test/2', '<html><head><title> </title><meta property="og:title" content="OG"><script type="application/ld+json">{}</script></head><body><h2>S</h2><img data-alt="x" src="c.jpg"><a href="/rel">in</a><a href="https://y.test/"></a></body></html>'),
 ('https://x.test/3', '<html lang=""><head><title>A title that goes on for rather more than sixty characters in all</title><meta name="robots" content="index"></head><body><h1 class="k">One <b>two</b></h1><h3>deep</h3><style>p{}</style><p>three four</p></body></html>')
) AS t(url, html)"""

SEEDS = r"""SELECT industry, mood, CAST(hue AS DOUBLE) AS hue, CAST(sat AS DOUBLE) AS sat, CAST(light AS DOUBLE) AS light FROM (VALUES
 ('bank', 'calm-trust', 210, 0.60, 0.42), ('food', 'warm', 18, 0.75, 0.50), ('games', 'loud-neon', 290, 0.90, 0.60), ('law', 'serious', 0, 0.0, 0.25)
) AS t(industry, mood, hue, sat, light)"""

REQUESTS = r"""SELECT * FROM (VALUES (1, 'Shop', 'retail', 'fast bold'), (2, 'blog', 'media', 'quiet paper'), (3, 'portal', 'unknown', 'zzz'), (4, 'shop', 'retail', 'soft glass'))
 AS t(id, product_type, industry, keywords)"""

PRODUCTS = r"""SELECT * FROM (VALUES
 (0, 'landing', 'software', 'hero', 'plain', 'clear modern', 'modern sans', 'hero;features, cta', 'clutter;slow', 'for apps'),
 (1, 'shop', 'retail', 'grid', 'bold', 'vivid', 'strong sans', 'hero;collection;reviews', 'popups', 'for sales'),
 (2, 'journal', 'media', 'column', 'paper', 'quiet', 'serif reading', 'story;about', 'ads,popups', 'for reading')
) AS t(row_idx, product_type, industry, recommended_pattern, recommended_style, palette_mood, typography_mood, key_sections, anti_patterns, notes)"""

STYLES = r"""SELECT * FROM (VALUES
 (0, 'plain', 'calm', 'clean lines', 'apps', 'noise', 'modern'), (1, 'bold', 'loud', 'big type', 'sales', 'quiet', 'vivid'),
 (2, 'soft glass', 'airy', 'blur', 'apps', 'print', 'soft'), (3, 'soft', 'round', 'shadow', 'apps', 'print', 'soft')
) AS t(row_idx, style, summary, characteristics, best_for, avoid_for, mood_tags)"""

PALETTES = r"""SELECT * FROM (VALUES
 (0, 'ink', 'media', 'quiet', 'light;paper', 'pass'), (1, 'sun', 'retail', 'vivid', 'light', 'fail'), (2, 'sky', 'retail', 'calm', 'light', 'pass')
) AS t(row_idx, name, industry, mood, tags, aa_body_text)"""

LINKS = r"""SELECT * FROM (VALUES ('s1', 'technical', 80.0), ('s1', 'content', 60.0), ('s1', 'ai', 90.0), ('s2', 'schema', 50.0), ('s3', 'other', 10.0)) AS t(site, specialist, score)"""

FINDINGS = r"""SELECT * FROM (VALUES ('s1', 'title', 'critical'), ('s1', 'title', 'medium'), ('s1', 'h1', 'high'), ('s2', 'h1', 'info')) AS t(site, code, severity)"""

SCORES = r"""SELECT * FROM (VALUES ('a', 'speed', 2.0), ('b', 'speed', 2.5), ('a', 'design', 4.0), ('b', 'design', 1.0), ('a', 'trust', 1.0), ('b', 'trust', 2.9)) AS t(competitor, dimension, score)"""

RESULTS = r"""SELECT * FROM (VALUES ('k1', 1, 'u1'), ('k1', 2, 'u2'), ('k1', 3, 'u3'), ('k2', 1, 'u1'), ('k2', 2, 'u3'), ('k2', 3, 'u4'), ('k3', 1, 'u9'), ('k3', 2, 'u1'), ('k4', 11, 'u1'), ('k4', 1, 'u4')) AS t(keyword, rank, url)"""

SITEMAPS = r"""SELECT * FROM (VALUES
 (1, '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>https://a.test/</loc></url><url><loc>/b</loc></url></urlset>'),
 (2, '<sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><sitemap><loc>https://a.test/1.xml</loc></sitemap></sitemapindex>'),
 (3, '<urlset><url><loc>https://a.test/</loc></url></urlset>'), (4, '<urlset><url></urlset>'), (5, '<feed xmlns="x"></feed>'), (6, 'not xml')
) AS t(id, xml)"""
