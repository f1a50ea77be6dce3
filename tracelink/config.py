"""Thresholds and fixed lists of the attribution operators."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Conf:
    """Every threshold an operator compares with."""

    param_hash_length: int = 100
    param_min_posts: int = 2
    key_min_posts: int = 3
    key_min_values: int = 2
    key_max_domains: int = 5
    cert_window_hours: int = 24
    min_domains: int = 2
    min_observations: int = 2
    manager_breadth: float = 0.8
    template_min_shared: int = 8
    template_overlap: float = 0.4
    manager_pair_ratio: float = 0.6
    operator_max_apexes: int = 4
    manager_min_apexes: int = 10
    carrier_max_accounts: int = 500
    platform_accounts: int = 300
    commodity_prevalence: float = 0.005
    header_min_length: int = 8
    weak_breadth: float = 0.8
    opsec_high: float = 0.70
    opsec_low: float = 0.20
    opsec_browser: float = 0.70
    cloaking_size: float = 0.30
    coverage_cap: int = 3
    coverage_weights: tuple[int, int, int] = (6, 3, 1)
    new_domain_days: int = 180
    tracker_apexes: int = 3
    hop_threshold: int = 3
    sample_size: int = 5


# Fixed values, in natural order: all must equal what analysts' earlier results were made with.

#: Query keys by the platform they belong to.
PARAM_KEYS = {
    "google_analytics": ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id"],
    "google_ads": ["gclid", "gclsrc", "gbraid", "wbraid"],
    "google_ads_dcm": ["dclid"],
    "meta_facebook": ["fbclid", "fb_action_ids"],
    "x_twitter": ["twclid"],
    "microsoft_ads": ["msclkid"],
    "tiktok_ads": ["ttclid"],
    "yahoo_ads": ["yclid"],
    "hubspot": ["hsa_cam", "hsa_grp", "hsa_src", "hsa_net"],
    "mailchimp": ["mc_cid", "mc_eid"],
    "line_liff": ["liffid"],
    "klaviyo": ["_kx", "kxidcid"],
    "generic": ["ref", "aff", "aff_id", "affiliate_id", "uid", "sid", "click_id", "tracking_id", "campaign_id", "source"],
}
#: Key prefixes in the order in which they are tried.
PARAM_PREFIXES = [
    ("utm_", "google_analytics"),
    ("hsa_", "hubspot"),
    ("mc_", "mailchimp"),
    ("fb_", "meta_facebook"),
    ("_ga", "google_analytics"),
    ("af_", "appsflyer"),
    ("klaviyo_", "klaviyo"),
]
#: Platform ids of tracking labels found in HTML.
LABEL_PLATFORMS = {
    "Meta Pixel": "meta_facebook",
    "Google Analytics 4": "google_analytics",
    "Google Analytics (UA)": "google_analytics",
    "Google Tag Manager": "google_tag_manager",
    "Google Ads": "google_ads",
    "TikTok Pixel": "tiktok_ads",
    "Microsoft Clarity": "microsoft_clarity",
    "Hotjar": "hotjar",
    "LINE Tag": "line_tag",
    "X / Twitter Pixel": "x_twitter",
    "Google AdSense": "google_adsense",
    "Meta Facebook Page": "meta_facebook_page",
}
EXCHANGES = """33across.com adform.com adyoulike.com amxrtb.com appnexus.com betweendigital.com contextweb.com criteo.com districtm.io
    e-planning.net freewheel.tv genieegroup.com genieesspv.jp gumgum.com improvedigital.com indexexchange.com lijit.com media.net onetag.com openx.com
    outbrain.com pubmatic.com rhythmone.com richaudience.com rubiconproject.com sharethrough.com smartadserver.com smartyads.com sovrn.com spotx.tv
    spotxchange.com taboola.com teads.tv themediagrid.com triplelift.com unrulymedia.com video.unrulymedia.com yahoo.com yieldmo.com""".split()
NOISE_HOSTS = """adtrafficquality.google aspnetcdn.com bootstrapcdn.com cdnjs.cloudflare.com cloudflareinsights.com code.jquery.com doubleclick.net
    facebook.net fbcdn.net google-analytics.com google.com googleadservices.com googleapis.com googlesyndication.com googletagmanager.com
    googletagservices.com gstatic.com jsdelivr.net unpkg.com youtube.com ytimg.com""".split()
TRACKERS = """adnxs.com amplitude.com clarity.ms doubleclick.net facebook.net google-analytics.com googlesyndication.com googletagmanager.com
    hotjar.com mixpanel.com outbrain.com segment.com taboola.com""".split()
SHORTENERS = """amzn.to bit.ly bitly.com bl.ink buff.ly clck.ru cutt.ly dlvr.it fb.me goo.gl ift.tt ig.me is.gd lnkd.in ow.ly picsee.co ppt.cc
    rb.gy rebrand.ly reurl.cc s.id short.io short.link shrtco.de t.co tiny.cc tiny.one tinyurl.com trib.al v.gd vm.tiktok.com youtu.be""".split()
BAD_EXTENSIONS = ".7z .apk .bat .dmg .exe .jar .msi .ps1 .rar .sh .zip".split()
MULTI_LABEL_SUFFIXES = """ac.jp ac.uk co.jp co.kr co.uk com.au com.br com.cn com.hk com.mx com.my com.sg com.tw edu.au edu.tw go.jp gov.au gov.cn
    gov.tw gov.uk idv.tw me.uk ne.jp net.au net.cn net.tw net.uk or.jp or.kr org.au org.cn org.hk org.tw org.uk""".split()
VOLATILE_HEADERS = """age alt-svc cf-cache-status cf-ray content-encoding content-length date etag expires last-modified set-cookie vary via
    x-amz-cf-id x-amz-cf-pop x-cache x-cache-hits x-request-id x-served-by x-timer x-trace-id""".split()
TEMPLATE_HEADERS = "server x-aspnet-version x-backend-server x-host x-powered-by x-server-hosted".split()
VERSION_HEADERS = "server x-aspnet-version x-powered-by x-runtime".split()
INDEX_NOISE_HEADERS = """x-content-type-options x-dns-prefetch-control x-download-options x-frame-options x-permitted-cross-domain-policies
    x-robots-tag x-ua-compatible x-xss-protection""".split()
UNIVERSAL_TOKENS = "akamai amazon amazons3 apache cloudflare ecs gse gws litespeed microsoft-iis nginx openresty".split()
PLACEHOLDERS = "00000000 11111111 12345678 123456789 ABCDEFG ABCDEFGH ABCDEFGHI EXAMPLE PLACEHOLDER TODO YOURID YOUR_ID".split()
ECHO_HEADERS = """cf-connecting-ip cip client-ip custom-connecting-ip fastly-client-ip remote-addr true-client-ip x-client-address x-client-ip
    x-cluster-client-ip x-connecting-ip x-envoy-external-address x-forwarded-for x-original-forwarded-for x-originating-ip x-proxy-origin x-real-ip
    x-remote-addr x-request-ip x-user-ip x-your-ip yourip""".split()
ECHO_KEYS = "auip cip client_ip clientip ip ip_addr ipaddr user_ip userip".split()
SIGNAL_TYPES = """final_domain registrar asn cert_serial tracking_id gtm_container header_value har_endpoint ads_txt_template ads_txt_owner
    ads_txt_manager ads_txt_seller""".split()
#: Impossible software versions: header value pattern (any case) and the reason given.
FAKE_VERSIONS = [
    (r"apache/(?:2\.(?:[5-9]|[1-9][0-9])|[3-9])", "Apache 2.5 or later was never released"),
    (r"openssl/1\.1\.2", "OpenSSL 1.1.2 was never released"),
    (r"php/(?:9|1[0-9])(?:\.|\b)", "PHP 9 or later was never released"),
    (r"nginx/[2-9]\.", "nginx 2 or later was never released"),
]
