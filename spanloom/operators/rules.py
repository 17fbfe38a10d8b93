"""Rule packs: what the scan looks for. Packs are data; the scan is the same for all."""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    rid: str
    category: str
    weight: int
    pattern: str
    disclosure: bool = False


@dataclass(frozen=True)
class Pack:
    """Rules in order, the noise pattern, the categories that shield a span from it, those that are implicit,
    the disclosure category, and the pattern of administrative status."""

    rules: tuple[Rule, ...]
    noise: str
    technical: tuple[str, ...]
    implicit: tuple[str, ...]
    disclosure_category: str
    status: str


#: Units and effect words of the Korean pack.
UNIT = (
    r"(?:nm|㎚|㎛|um|µm|mm|㎜|cm|㎝|m|km|Hz|㎐|kHz|MHz|GHz|ms|㎳|㎲|us|sec|s|초|분|시간|"
    r"°|℃|도|%|퍼센트|배|ppm|ppb|kg|㎏|g|mg|t|톤|W|㎾|kW|MW|V|㎷|mV|A|mA|rpm|bar|MPa|㎫|Pa|"
    r"psi|N|Nm|dB|px|㎡|㎥|L|㎖|ml|건|회|개|조|장|층|단|축|ch|bit|byte|KB|MB|GB|TB|fps|EA)"
)
EFFECT_VERB = (
    r"(?:절감|감축|저감|단축|축소|감소|억제|제거|향상|개선|상승|증가|확대|"
    r"안정화|고도화|최적화|극대화|최소화|균일화|정밀화|경량화|소형화|자동화|무인화)"
)

#: Rules, noise words and status words of the Korean pack.
KOREAN = Pack(
    rules=(
        Rule("NUM_RANGE", "수치·범위한정", 5, rf"\d+(?:\.\d+)?\s*[~∼〜–—\-]\s*\d+(?:\.\d+)?\s*{UNIT}"),
        Rule("NUM_TOL", "수치·범위한정", 5, rf"[±±]\s*\d+(?:\.\d+)?\s*{UNIT}"),
        Rule("NUM_UNIT", "수치·범위한정", 3, rf"\d+(?:\.\d+)?\s*{UNIT}\b"),
        Rule("NUM_RATIO", "수치·범위한정", 4, r"\d+\s*(?::|대)\s*\d+\s*(?:비율|로|의|배합|혼합)?"),
        Rule("NUM_SHIFT", "효과만기재", 5, rf"[\w\.\±%㎛°]+\s*(?:→|->|⇒|에서)\s*[\w\.\±%㎛°]+\s*(?:로|으로)?\s*(?:{EFFECT_VERB}|개선|변경)?"),
        Rule("STRUCT_STAGE", "구성·구조", 4, r"(?:\d+|이|삼|사|다)\s*단계(?:\s*(?:구조|구성|처리|추론|분리|검사))?"),
        Rule("STRUCT_WORD", "구성·구조", 3, r"(?:구조|구성|배치|배열|적층|결합|체결|연결|모듈|유닛|아키텍처|파이프라인|계층|이중화|직렬|병렬|캐스케이드|폐루프|피드백|피드포워드)"),
        Rule("CTRL_ALGO", "제어·알고리즘", 4, r"(?:알고리즘|제어\s*(?:로직|방식|기법|주기)|보정|캘리브레이션|임계값?|threshold|추론|학습|증강|augmentation|전처리|후처리|필터링|스케줄링|동기화|샘플링)"),
        Rule("PROC_METHOD", "공정·방법", 4, r"(?:공정|프로세스|처리\s*순서|절차|레시피|조건\s*(?:설정|제어)|투입|성막|코팅|도포|소성|건조|압연|절단|접합|검사\s*순서)"),
        Rule("IMP_EFFECT_NUM", "효과만기재", 6, rf"\d+(?:\.\d+)?\s*(?:%|퍼센트|배|㎛|nm|ms|초|분|건|원|억|만)?\s*{EFFECT_VERB}"),
        Rule("IMP_EFFECT", "효과만기재", 4, rf"(?:{EFFECT_VERB})(?:됨|했|하였|하여|하고|시킴|시켜|시킬|함|한다|합니다)?"),
        Rule("IMP_OWN", "독자성주장", 6, r"(?:자체|자사|사내|독자(?:적)?|고유|자력|in[\s\-]?house)\s*(?:개발|설계|제작|구현|기술|방식|방법|공법|노하우|보유|확보|구축)?"),
        Rule("IMP_LOCALIZE", "독자성주장", 5, r"(?:국산화|내재화|자립화|수입\s*대체|외산\s*대체|탈[\s]?의존)"),
        Rule("IMP_OPTIMIZE", "최적화·조건확립", 6, r"(?:최적(?:화|값|점|조건)|튜닝|파인튜닝|조건\s*(?:확립|도출|정립|최적화)|레시피\s*(?:도출|확립)|표준\s*(?:사양|화|모델)|사양\s*확정|스펙\s*확정|파라미터\s*(?:도출|결정|조정)|시행\s*착오|실험적으로|경험적으로)"),
        Rule("IMP_CONFIRM", "최적화·조건확립", 5, r"(?:확정|채택|선정|결정)(?:함|했|하였|됨|되었)?"),
        Rule("IMP_SOLVE", "문제해결", 6, r"(?:문제|이슈|애로|한계|병목|불량|결함|리스크|난제)\s*(?:를|을|가|이)?\s*(?:해결|해소|극복|개선|보완|제거|완화|대응)"),
        Rule("IMP_ENABLE", "문제해결", 5, rf"(?:통해|함으로써|으로써|적용하여|도입하여|구현하여|반영하여|기반으로)\s*\S*\s*(?:{EFFECT_VERB}|가능|달성|실현|확보)"),
        Rule("IMP_COMPARE", "비교우위", 5, r"(?:기존|종래|현행|경쟁사|타사|업계|시장|국내|세계)\s*(?:대비|보다|최초|최고|유일|선도)"),
        Rule("IMP_FIRST", "비교우위", 6, r"(?:업계|국내|세계|글로벌|양산)\s*(?:최초|첫|유일)|차별화|독보적|타사\s*불가"),
        Rule("IMP_BLACKBOX", "블랙박스용어", 5, r"(?:노하우|know[\s\-]?how|기술력|엔진|로직|솔루션|플랫폼|프레임워크|기법|메커니즘|방식|원리|비법|핵심\s*기술|요소\s*기술|기반\s*기술)"),
        Rule("IMP_CAPABLE", "문제해결", 4, r"(?:가능(?:하게|해짐|함|케)|실현|달성|구현|확보|대응\s*가능|양산\s*적용|현장\s*적용)"),
        Rule("IMP_AUTO", "제어·알고리즘", 5, r"(?:자동(?:으로|화|\s*조정|\s*판정|\s*보정|\s*제어)|실시간|온라인|인라인|무인)"),
        Rule("RISK_SHOW", "공개이력", 8, r"(?:전시(?:회|장)?|박람회|시연|데모|demo|부스|booth|공개\s*시연|쇼케이스|InterBattery|CES|K[\s\-]?BATTERY)", True),
        Rule("RISK_PAPER", "공개이력", 8, r"(?:논문|학회|학술(?:대회|지)?|초록|abstract|저널|발표\s*(?:예정|함|자료)|포스터|세미나|기술\s*설명회|컨퍼런스)", True),
        Rule("RISK_PR", "공개이력", 7, r"(?:보도\s*자료|press|홍보|카탈로그|브로슈어|제품\s*소개서|IR\s*자료|기업\s*설명회|홈페이지\s*게시|SNS|유튜브)", True),
        Rule("RISK_SHARE", "공개이력", 6, r"(?:제안서|견적서|사양서|도면\s*(?:제공|공유|송부)|고객사\s*(?:제출|공유|전달)|협력사\s*(?:공유|제공)|기술\s*이전|공동\s*개발|MOU|NDA\s*(?:미|없))", True),
        Rule("RISK_PRIOR", "공개이력", 4, r"(?:공개\s*특허|등록\s*특허|선행\s*기술|특허\s*(?:출원|등록|분석|회피|맵)|IP|지식\s*재산|침해|무효|저촉)"),
        Rule("RISK_LAUNCH", "공개이력", 6, r"(?:출시|런칭|양산\s*(?:개시|시작|착수)|SOP|납품\s*(?:완료|개시)|판매\s*개시|상용화)", True),
    ),
    noise=(
        r"(?:매출(?:액|액수)?|영업\s*이익|이익률|순이익|손익|수익성|원가율|점유율|판매\s*단가|평균\s*단가|단가\s*(?:하락|인상|압력)|"
        r"수주\s*(?:액|잔고|건)|공급\s*확정|물량|인원|충원|채용|조직도|예산|투자비|감가상각|배당|주가|시가\s*총액|"
        r"목차|아젠다|agenda|감사합니다|thank\s*you|대외비|confidential|페이지|슬라이드)"
    ),
    technical=("구성·구조", "제어·알고리즘", "공정·방법"),
    implicit=("효과만기재", "독자성주장", "최적화·조건확립", "문제해결", "비교우위", "블랙박스용어"),
    disclosure_category="공개이력",
    status=r"(?:특허|지식\s*재산|IP|지재권)\s*(?:출원|등록|검토|현황|담당|전략|건수|여부|미착수|예정)|출원\s*(?:0\s*건|없음|미착수|예정|이력|현황|여부)",
)

#: A pack of patterns that Java's and RE2's expressions read alike, for corpora of plain text.
CORPUS = Pack(
    rules=(
        Rule("NUMBER", "number", 3, r"[0-9]+"),
        Rule("ADDRESS", "address", 5, r"[0-9]{1,3}(?:[.][0-9]{1,3}){3}"),
        Rule("MAIL", "contact", 6, r"[a-z0-9._]+@[a-z0-9.]+"),
        Rule("SECRET", "release", 8, r'token = "[0-9a-f]+"', True),
        Rule("LICENSE", "release", 6, r"licensed under [a-z0-9 .-]+", True),
        Rule("RIGHTS", "release", 4, r"all rights reserved"),
        Rule("SHOUT", "emphasis", 4, r"!!"),
        Rule("COLUMN", "layout", 2, r" [|] "),
    ),
    noise=r"[$]{3}|&&&|the the",
    technical=("address", "contact"),
    implicit=("emphasis",),
    disclosure_category="release",
    status=r"rights reserved|version [0-9]",
)


def user_rules(keywords: list[str]) -> tuple[Rule, ...]:
    """Rules for added keywords: weight 8, words joined by optional white space; numbers count skipped entries too."""
    found = []
    for i, k in enumerate(keywords, 1):
        words = (k or "").split()
        if len((k or "").strip()) >= 2:
            found.append(Rule(f"USER_{i}", "사용자추가", 8, r"\s*".join(re.escape(w) for w in words)))
    return tuple(found)
