"""The first generation of features: text tests on the URL and the raw page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlguard.functions.features import months_between, warns
from urlguard.functions.urls import authority, is_ipv4

# --- fixed values: shortener pattern of the first generation (case matters) ---------
SHORTENER_PATTERN = (
    r"bit\.ly|goo\.gl|shorte\.st|go2l\.ink|x\.co|ow\.ly|t\.co|tinyurl|tr\.im|is\.gd|cli\.gs|"
    r"yfrog\.com|migre\.me|ff\.im|tiny\.cc|url4\.eu|twit\.ac|su\.pr|twurl\.nl|snipurl\.com|"
    r"short\.to|BudURL\.com|ping\.fm|post\.ly|Just\.as|bkite\.com|snipr\.com|fic\.kr|loopt\.us|"
    r"doiop\.com|short\.ie|kl\.am|wp\.me|rubyurl\.com|om\.ly|to\.ly|bit\.do|t\.co|lnkd\.in|"
    r"db\.tt|qr\.ae|adf\.ly|goo\.gl|bitly\.com|cur\.lv|tinyurl\.com|ow\.ly|bit\.ly|ity\.im|"
    r"q\.gs|is\.gd|po\.st|bc\.vc|twitthis\.com|u\.to|j\.mp|buzurl\.com|cutt\.us|u\.bb|yourls\.org|"
    r"x\.co|prettylinkpro\.com|scrnch\.me|filoops\.info|vzturl\.com|qr\.net|1url\.com|tweez\.me|v\.gd|tr\.im|link\.zip\.net"
)


def features_v1(df: DataFrame, as_of: str) -> DataFrame:
    """Adds the reachable ``v1_*`` columns.

    Needs ``url, html, redirect_count, creation_date, expiration_date``; a null page or
    date means that look-up failed, which counts as phishing here.
    """
    url, page = F.col("url"), F.col("html")
    net = authority(url)
    today = F.lit(as_of).cast("date")
    created, expires = F.col("creation_date"), F.col("expiration_date")
    dots = F.length(url) - F.length(F.replace(url, F.lit("."), F.lit("")))
    links = F.regexp_count(page, F.lit("<a href="))
    last_double_slash = F.length(url) - F.instr(F.reverse(url), "//") - 1

    def found(condition: Column) -> Column:
        """These text tests are safe when the pattern is present."""
        return F.when(condition, 1).otherwise(-1)

    old_enough = found(months_between(today, created) >= 6)
    return df.withColumns(
        {
            "v1_using_ip": warns(is_ipv4(url)),
            "v1_long_url": F.when(F.length(url) < 54, 1)
            .when(F.length(url) <= 75, 0)
            .otherwise(-1),
            "v1_short_url": warns(url.rlike(SHORTENER_PATTERN)),
            "v1_symbol_at": warns(F.contains(url, F.lit("@"))),
            "v1_redirecting": warns(F.contains(url, F.lit("//")) & (last_double_slash > 6)),
            "v1_prefix_suffix": warns(F.contains(net, F.lit("-"))),
            "v1_sub_domains": F.when(dots == 1, 1).when(dots == 2, 0).otherwise(-1),
            "v1_https": found(F.startswith(url, F.lit("https://"))),
            "v1_domain_reg_len": found(months_between(expires, created) >= 12),
            "v1_non_std_port": warns(F.contains(net, F.lit(":"))),
            "v1_https_domain_url": warns(F.contains(net, F.lit("https"))),
            "v1_website_forwarding": F.when(page.isNull(), -1)
            .when(F.col("redirect_count") <= 1, 1)
            .when(F.col("redirect_count") <= 4, 0)
            .otherwise(-1),
            "v1_status_bar_cust": found(page.rlike("<script>.+onmouseover.+</script>")),
            "v1_disable_right_click": found(page.rlike("event.button ?== ?2")),
            "v1_using_popup_window": found(page.rlike(r"alert\(")),
            "v1_iframe_redirection": found(page.rlike("[<iframe>|<frameBorder>]")),
            "v1_age_of_domain": old_enough,
            "v1_dns_recording": old_enough,
            "v1_links_pointing": F.when(links == 0, 1).when(links <= 2, 0).otherwise(-1),
        }
    )


V1_NAMES = (
    "v1_using_ip", "v1_long_url", "v1_short_url", "v1_symbol_at", "v1_redirecting",
    "v1_prefix_suffix", "v1_sub_domains", "v1_https", "v1_domain_reg_len", "v1_non_std_port",
    "v1_https_domain_url", "v1_website_forwarding", "v1_status_bar_cust",
    "v1_disable_right_click", "v1_using_popup_window", "v1_iframe_redirection",
    "v1_age_of_domain", "v1_dns_recording", "v1_links_pointing",
)
